"""Readers: file names, delimited text, JSON records, arrays, archives, inventory."""
