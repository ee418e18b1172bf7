"""tessera — a Spark-native data-mining library.

Every operator is a function ``DataFrame -> DataFrame`` that builds a lazy
Spark plan (DataFrame / SQL API); model-fitting operators run Spark jobs
(MLlib or plain aggregations) and return DataFrames as well.
"""

from tessera.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to executors carry their helpers with them, so workers need no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
