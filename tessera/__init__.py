"""tessera — distributed collection operators, word count, sorting and
k-means, expressed as ordinary Spark DataFrame plans.

Every operator takes and returns a ``pyspark.sql.DataFrame``; nothing is
pulled through the driver except bounded metadata (partition counts,
k x d centres, histogram edges).
"""

from tessera.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
