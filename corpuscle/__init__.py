"""Corpuscle: a Spark-native engine for searchable text and source-code corpora."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the job, so that the
# package has to be installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
