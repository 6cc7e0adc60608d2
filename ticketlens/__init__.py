"""ticketlens: support-ticket analytics as Spark DataFrame plans.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects (or a
small driver-side record built from a bounded aggregate), so steps compose with
``df.transform(...)`` and run unchanged on ``local[*]`` or a large cluster.
"""

__version__ = "0.1.0"
