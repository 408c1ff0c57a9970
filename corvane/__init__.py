"""Corvane: claim verification, evidence retrieval and text preparation as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their jobs, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
