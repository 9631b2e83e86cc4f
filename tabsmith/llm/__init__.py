"""Operators for preparing language-model training data (URLs, duplicates, toxicity, PII, quality, tokens).

The functions that run inside tasks are pickled by value, so executors need the
libraries they use but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
