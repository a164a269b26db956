"""lexiflow: prepare, corrupt, correct and score noisy text pairs on Spark.

Every public function takes and returns a ``DataFrame`` or a ``Column``; the work
runs as Spark jobs (column expressions, joins, aggregations, windows).
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle the package's functions by value, so UDFs defined here run on
    executors that do not have the package installed."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
