"""dayloom: behaviour analytics over interval activity logs, on Spark."""

import sys

from pyspark import cloudpickle

from dayloom.session import build_session, prepare_session

# Functions that run in tasks travel with the task: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "prepare_session"]
