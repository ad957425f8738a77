"""peerlens: find and rank experts with Spark.

Every operator takes and returns DataFrames. Nothing runs until the caller
asks for rows, except where a docstring says that a checkpoint is cut.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
