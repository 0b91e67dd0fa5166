"""bookflow: prepare, translate and quality-check book corpora as Spark tables."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Workers get the package's few Python functions by value: nothing has to be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
