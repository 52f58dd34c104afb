"""Training-data operators.

Nothing else in ``leafmill`` imports this subpackage; it can be deleted
together with ``tests/llm`` and ``corpus_pipeline.py``.
"""
