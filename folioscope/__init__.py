"""folioscope: a PySpark-native engine for evaluating text extracted from scanned documents."""

import os
import sys

__version__ = "0.1.0"


def _ship_by_value_unless_importable() -> None:
    """Python workers import this package from PYTHONPATH or the working folder; elsewhere it travels inside the pickled functions."""
    seen = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if not any(p and os.path.exists(os.path.join(p, "folioscope", "__init__.py")) for p in seen):
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value_unless_importable()
