"""Training-data operators. Nothing outside this subpackage imports it.

Each ``opN_<name>`` module holds one operator (a general interface) and the thin
query that derives its digest columns; ``queries.py`` collects the queries.
"""
