"""Corpus-preparation operators for training-data pipelines.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, keeps whole texts, and cuts lineage only through files in the shared
folder named by ``spark.checkpoint.dir``.
"""
