"""Training-data operators: quality, language, dedup, packing, decontamination and language models.

Nothing outside this subpackage imports it; ``millrace.llm.queries`` holds the registered queries.
"""
