"""millrace: Spark jobs that turn a code corpus into training windows and measure the result."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so that executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
