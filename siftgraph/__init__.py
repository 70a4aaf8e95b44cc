"""Corpus analytics on Spark: gate, score, cluster, label, link and search a text corpus.

Every operator takes DataFrames and returns a DataFrame; Catalyst picks the physical plan.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
