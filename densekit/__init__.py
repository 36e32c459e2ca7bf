"""densekit: dense-retrieval data work as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions shipped to Python workers carry their code along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
