"""fluxgate: a Spark-native engine for self-describing science-array files."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers take their code along, so that executors need
# not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
