"""Operators for training-data pipelines: near copies, packing, sharding, archives, scoring.

Nothing else of the library imports this package.
"""

import sys

from pyspark import cloudpickle

# the Python steps travel with their jobs: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
