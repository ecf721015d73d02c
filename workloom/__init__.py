"""Labour-market analytics expressed as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few Python functions travel to the executors with the job, so a cluster needs no copy
# of this package on its nodes.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
