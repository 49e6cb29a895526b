"""codemem: a queryable memory over source code, built from Spark jobs.

Every operator takes DataFrames and returns a DataFrame.  The few Python stages
(parsing Python source, reading files, block scoring of vectors) are shipped to
the executors by value, so a cluster needs no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
