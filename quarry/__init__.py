"""quarry — a Spark-native engine for chunking, indexing and searching text corpora.

Every operator takes and returns DataFrames; the heavy lifting is left to
Catalyst (built-in expressions, joins, aggregates, windows) and, where numpy
block maths is genuinely faster, to Arrow-batched ``mapInArrow`` tasks.
"""

import sys as _sys


def _ship_by_value() -> None:
    """Pickle this package's functions by value, so Python workers (on any
    executor, from any working directory) never need ``quarry`` installed."""
    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(_sys.modules[__name__])
    except Exception:  # noqa: BLE001 — older cloudpickle: rely on --py-files
        pass


_ship_by_value()

from quarry.session import checkpoint_dir, get_session  # noqa: E402,F401

__all__ = ["get_session", "checkpoint_dir"]
