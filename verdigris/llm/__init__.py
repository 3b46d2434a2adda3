"""Training-data operators: independent modules and the queries over them.

Nothing outside this subpackage imports it; see ``entry_queries`` for the registered queries.
"""
