"""Training-data operators: fingerprints, deduplication, packing, scoring, sharding, mixing.

Nothing outside this folder (and corpus_pipeline.py) imports it.
"""
