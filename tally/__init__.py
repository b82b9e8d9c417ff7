"""tally: sales analytics as Spark DataFrame operators.

Every operator takes and returns a ``pyspark.sql.DataFrame`` (or a ``Column``)
and is built from Spark SQL built-in functions, so the whole plan stays inside
Catalyst and whole-stage codegen.  Sub-packages:

* ``sources``    typed readers (CSV, Parquet) and the fact-view adapter
* ``functions``  column functions: calendar, text, measures and labels
* ``operators``  grouped aggregates, zero-filled domains, pivots, rankings, profiles
* ``plans``      the named reports composed from the operators
* ``streaming``  the same grouped reports maintained incrementally
"""

__version__ = "0.1.0"
