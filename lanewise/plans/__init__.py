"""Jobs, and the catalogue of queries over the test tables."""
