"""Edge-disjoint trails and Eulerian circuits of large undirected multigraphs, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from graphtrails.scratch import Scratch

# Task functions travel with the plan, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Scratch"]
