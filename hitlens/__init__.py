"""hitlens: web access-log analytics as composable PySpark operators."""

import sys

from pyspark import cloudpickle

# The few functions that run inside Python tasks travel with the job, so executors
# need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
