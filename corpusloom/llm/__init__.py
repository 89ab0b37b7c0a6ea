"""Training-data operators: scoring, formatting, deduplication, filtering, tokenising.

Each module holds one operator with a general interface over any DataFrame;
``corpusloom.llm.queries`` binds them to the ``documents``, ``benchmark`` and
``conversations`` tables.  Nothing outside this subpackage imports it.
"""
