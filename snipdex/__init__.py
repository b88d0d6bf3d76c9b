"""snipdex: corpus indexing and semantic search as Spark DataFrame operators."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions sent to executors travel with their code, so workers need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
