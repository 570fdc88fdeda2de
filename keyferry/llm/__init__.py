"""Operators of a training-data pipeline, their queries and their SQL."""

import sys

from pyspark import cloudpickle

# functions are sent to the workers whole, so that these need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
