"""Training-data operators: sharding, decontamination, deduplication, language-model
scoring, token counting, WARC derivatives, toxicity, packing and fingerprints.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries and
``oracle`` their SQL.
"""

import sys

from pyspark import cloudpickle

# What tasks run travels by value, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
