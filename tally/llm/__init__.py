"""Operators of a training-data pipeline.

Nothing outside this package (but ``__spark_entry__.py``, and then only if the
package is present) imports it.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value: they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
