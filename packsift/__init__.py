"""Corpus-scale risk audit of browser-extension packages as Spark jobs."""

import sys

from pyspark import cloudpickle

# The few Python functions travel with their tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
