"""Operators for training-data pipelines; nothing else in the library imports them.

Functions that run in Python workers are pickled by value, so executors need
numpy, pandas and pyarrow, but not this package.
"""

from __future__ import annotations

from pyspark import cloudpickle

from . import ann, archive, clusters, common, neardup, quality, ranked, repeats, shards, token_files, toxicity

for _module in (common, neardup, toxicity, quality, archive, repeats, shards, ann, clusters, ranked, token_files):
    cloudpickle.register_pickle_by_value(_module)
