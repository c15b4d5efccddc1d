"""tessera: a Spark-native material catalog, matching and quoting engine."""
import sys as _sys

# Functions shipped to Python workers (mapInPandas / applyInPandas bodies) are
# pickled by value, so executors need no copy of this package on their path.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: ship the package with addPyFile instead
    pass
