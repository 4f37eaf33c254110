"""marlstone: Spark-native analytics for financial research data.

Functions of this package that run inside Python workers are pickled by value,
so executors need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
