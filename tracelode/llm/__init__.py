"""Corpus-preparation operators for training-data pipelines.

Nothing outside this package (but ``corpus_pipeline.py`` and the guarded
registration in ``__spark_entry__.py``) imports it.
"""
