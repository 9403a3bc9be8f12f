"""pricelens: listings price analytics as Spark DataFrame jobs."""

import sys as _sys

__version__ = "0.1.0"

# Python code that runs inside tasks (Arrow-batched pandas functions) is
# shipped by value with its closure, so executors need no installed copy of
# this package whatever session the caller built.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
