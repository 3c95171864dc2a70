"""Spark-native analytics over edit timelines, footage metrics, music tables, cut plans and takes."""

import sys

from pyspark import cloudpickle

# The few Python helpers that run on executors travel with the job, so workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
