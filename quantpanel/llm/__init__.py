"""Training-data operators: tokenising, license scans, deduplication, decontamination, sharding, toxicity and language.

Nothing outside this folder (and corpus_pipeline.py) imports it.
"""
