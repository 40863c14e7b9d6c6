"""Training-data operators: scoring, decontamination, formatting, deduplication, tokens.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
