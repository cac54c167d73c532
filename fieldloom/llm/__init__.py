"""Operators for preparing training text: each module holds one operator, `queries` registers them.

Nothing outside this folder imports it; the rest of the library works when it is deleted.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
