"""DataFrame operators on observations, links, statistics and the file log."""
