"""Find, group and review near-identical records with PySpark."""

import sys

from pyspark import cloudpickle

# Ship the functions that run in tasks by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
