"""Spark-native document retrieval analytics.

Functions that run in Python on executors are pickled by value, so workers need no copy of the
package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
