"""Training-data operators: filtering, deduplication, mixing, tokenising and scoring text corpora.

Nothing outside this subpackage imports it; ``paideia.llm.queries`` lists its registered queries.
"""
