"""Operators of a training-data pipeline: classifiers, filters, duplicate
detectors, sharding, packing, decontamination and chat formatting.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
