"""Training-data operators; nothing outside this subpackage imports it.

Task functions travel to the executors by value, so a worker needs no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
