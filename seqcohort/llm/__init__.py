"""Operators for large text corpora: duplicates, quality, languages, archives, packing."""

import seqcohort
from pyspark import cloudpickle

# Functions that run in Python workers travel by value: executors need not have the package.
cloudpickle.register_pickle_by_value(seqcohort)
