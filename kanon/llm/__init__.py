"""Training-data operators: one module per operator, their queries in :mod:`kanon.llm.queries`.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is present.
"""
