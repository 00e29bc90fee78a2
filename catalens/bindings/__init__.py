"""Views over the given tables, and the named queries that run the operators on them."""
