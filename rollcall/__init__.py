"""Payroll, workforce, pension-fund and forecast analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel with the job, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
