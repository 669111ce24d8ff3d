"""Operators for preparing training data, and the queries that apply them to whole tables.

Nothing else in the library imports this package.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers whole, so that a worker need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
