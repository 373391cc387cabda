"""A multi-model query engine on Spark: relational, JSON, paths, graphs, vectors, text, geometry, revisions."""

import sys

from pyspark import cloudpickle

# Python workers need not have the package installed: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
