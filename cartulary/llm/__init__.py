"""Training-data operators: packing, privacy, search, de-duplication, language.

Nothing outside this subpackage imports it. ``queries()`` and ``oracle_sql()``
live in :mod:`cartulary.llm.queries`.
"""
