"""threadlens: conversational-text annotation and evaluation on Spark.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` (or a
``Column`` for scalar functions); keys are explicit columns, never row order.
"""

__version__ = "0.1.0"
