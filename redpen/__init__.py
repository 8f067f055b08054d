"""Quality control of large collections of versioned reports, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
