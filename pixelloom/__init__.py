"""pixelloom: greyscale raster analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that go to Python workers carry the package's code with them: workers need no copy
# of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
