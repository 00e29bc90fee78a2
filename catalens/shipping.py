"""Code that runs in Python tasks."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_by_value(module: str) -> None:
    """Send functions of a module to the tasks as code, not by name.

    Executors then need no copy of this package on their path.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])
