"""Training-data operators: ten corpus stages with their queries.

Nothing outside this folder imports it.  Python functions shipped to executors
are pickled by value, so a cluster needs no copy of this package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
