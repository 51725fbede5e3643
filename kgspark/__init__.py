"""Knowledge-graph question-answering data operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions reach the workers by value, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
