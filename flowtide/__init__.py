"""flowtide: network-flow anomaly analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Ship the helpers used inside Python workers by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
