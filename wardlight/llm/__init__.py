"""Training-data operators: tokens, sharding, near duplicates, filters, classifiers, search.

Nothing outside this folder, tests/llm and corpus_pipeline.py imports it.
"""
