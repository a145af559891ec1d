"""papyrion: document analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Workers get the package's functions with the task, so that they need no installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
