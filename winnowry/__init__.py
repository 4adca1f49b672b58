"""Curation of large question-and-answer and feed corpora as Spark jobs."""

import sys

from pyspark import cloudpickle

# Helper functions travel to the Python workers with the job, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
