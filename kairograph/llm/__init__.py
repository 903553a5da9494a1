"""Operations of a large-scale training-data pipeline, one module per operator.

Nothing outside this subpackage imports it.  ``registry.queries()`` and
``registry.oracle_sql()`` list what ``__spark_entry__`` registers.
"""
