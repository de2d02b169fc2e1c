"""Spark operators for building verified reasoning datasets.

Every operator is a function ``DataFrame -> DataFrame`` (or a ``Column``
builder); nothing collects data rows to the driver.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the task, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
