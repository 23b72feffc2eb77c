"""Operators for building training corpora.

Nothing outside this folder imports it; ``queries.py`` and ``sql.py`` hold what
``__spark_entry__`` registers when the folder is present.
"""
