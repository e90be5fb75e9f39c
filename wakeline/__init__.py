"""Analytics over streams of moving-object reports, expressed as Spark plans.

Every public operator is a ``DataFrame -> DataFrame`` function with an explicit
evaluation time; nothing reads the wall clock.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
