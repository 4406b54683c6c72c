"""Contest analytics on Spark: DataFrame-in, DataFrame-out operators for head-to-head results."""

import sys

from pyspark import cloudpickle

# Grouped Arrow functions travel with the query, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
