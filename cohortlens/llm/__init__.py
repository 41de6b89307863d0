"""Training-data operators (deduplication, token counts, filters, packing).

Nothing else in the library imports this subpackage; ``__spark_entry__.py`` adds
its queries (``llm/queries.py``) and the ``pipeline`` query when it is there.
"""
