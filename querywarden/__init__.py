"""querywarden: privacy and safety processing of search traffic on Spark.

Subpackages: ``functions`` (rules as data, regex dialects, column helpers),
``sources`` (inputs and sinks), ``operators`` (DataFrame -> DataFrame steps),
``plans`` (composed jobs, reports, query catalog, oracle SQL) and
``streaming`` (Structured Streaming wrappers).
"""

import sys as _sys

__version__ = "0.1.0"

# Python functions of this package (pandas UDFs, mapInPandas folds) are
# shipped to executors by value, so workers need no installed copy of it.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the hook
    pass
