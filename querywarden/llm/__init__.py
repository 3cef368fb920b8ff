"""Training-data operators: sharding, tokenisation, deduplication, language, scoring.

One module per operator; ``catalog`` registers a query for each. Nothing
outside this subpackage (and ``corpus_pipeline``) imports it.
"""
