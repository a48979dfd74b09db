"""Operators for preparing training text: tokens, packing, quality, privacy,
near-duplicates and sharding.

Nothing else in the library imports this subpackage; deleting it (with
``tests/llm`` and ``corpus_pipeline.py``) leaves the rest working.
"""
