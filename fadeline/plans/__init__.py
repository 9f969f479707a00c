"""Whole jobs made of operators: views on the test tables, queries, ingestion."""
