"""Operators for preparing language-model training data.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports
it, so the folder can be removed without touching the rest of the library.
"""
