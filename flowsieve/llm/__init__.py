"""Operators for preparing training text at corpus scale.

Nothing else in the library imports this subpackage. The functions that run
inside tasks are shipped to the executors by value, so a cluster needs no
installed copy of the package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
