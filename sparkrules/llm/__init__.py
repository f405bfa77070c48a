"""Training-data operators: packing, scoring, classifying, deduplicating and formatting text.

Nothing outside this subpackage imports it.  ``registry.queries()`` lists its
queries and ``registry.oracle_sql()`` the SQL of those that SQL can express.
"""
