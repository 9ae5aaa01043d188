"""ternspark: Spark jobs for compositional and wide numeric tables."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
