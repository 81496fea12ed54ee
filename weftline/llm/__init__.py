"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()``
list what ``__spark_entry__`` registers.
"""
