"""docflow: document-intelligence operators as Spark DataFrame jobs.

Every public operator is ``f(df, ..., params) -> DataFrame``: lazy, no
``collect()`` inside, no driver loops over rows. See README.md for the map
from operators to modules.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Serialise this package's functions and classes into the tasks that use them
    (pandas UDFs, mapInPandas kernels, tokeniser hooks), so executors run them without
    having docflow installed or on their path."""
    import sys

    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older pyspark: ship the package with --py-files
        pass


_ship_by_value()
