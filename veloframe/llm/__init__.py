"""Operators that prepare training text.  Nothing else in the library imports this subpackage.

Each module holds one operator by one method and states in its docstring what it does
with nulls, empty texts, ties and repeated rows.  ``queries`` registers them over the
given tables.  Functions for the executors travel by value, so these need the libraries
but not this package; ``spark.checkpoint.dir`` must name a folder that all of them share.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
