"""Operators for sparse, co-observed measurement tables, written on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

ENTITY = "entity"
PROPERTY = "property"
VALUE = "value"

# functions that run inside Python tasks travel with the job, so that executors need
# neither this package nor the driver's working folder on their path
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
