"""The catalogue of named queries over the test tables and their SQL twins."""
