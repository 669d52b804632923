"""The operators applied to the test tables, each beside the same query in SQL."""
