"""Cohort research on wide tables, written as Spark DataFrame operators.

``functions``  column expressions (hash keys, JSON-in-string fields, text and array measures)
``operators``  DataFrame -> DataFrame operators: profile, cohort, context, responses, comparison, agreement, checks
``sources``    record schemas, readers and writers
``workflow``   the research steps end to end
``plans``      the registered queries on the given tables and their SQL twins
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that Python workers run travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
