"""Analytics over labelled sensor and document corpora on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
