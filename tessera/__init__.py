"""tessera: Spark-native ERP analytics and text-to-SQL corpus toolkit.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` (or a
``Column``); the heavy lifting is expressed with built-in column expressions so
Catalyst can prune, push down and code-generate it.
"""

__version__ = "0.1.0"
