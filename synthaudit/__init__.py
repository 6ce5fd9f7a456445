"""synthaudit — auditing synthetic tabular data on Spark.

Every operator is a DataFrame -> DataFrame function.  Inputs carry an
explicit key column (Spark has no row order); all sampling is by a
seeded md5 hash of that key, so results do not depend on partitioning.
"""

__version__ = "0.1.0"
