"""citeloom: a Spark-first engine for scholarly-literature discovery.

Every operator is a function from DataFrames to a DataFrame.  Nothing is
collected to the driver except bounded summaries, and every ordering carries an
explicit tie-break so that results do not depend on the physical plan.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
