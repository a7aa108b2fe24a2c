"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it.  Each module holds one operator with
its general interface, the thin query that applies it to a whole table, and, where
SQL can say the same, the SQL twin.
"""
