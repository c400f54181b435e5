"""Tables that cut a plan's lineage: written to the folder that all nodes share, and read again."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry.plans.session import checkpoint_dir

_roots: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """A folder for this application below ``spark.checkpoint.dir``; it is deleted when the process ends."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        checkpoint_dir(spark)
        _roots[app] = root = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/stages-{app}"
        path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root), spark.sparkContext._jsc.hadoopConfiguration()

        def clean() -> None:
            try:
                path.getFileSystem(conf).delete(path, True)
            except Exception:  # the JVM is gone already; the folder goes with the checkpoint folder
                pass

        atexit.register(clean)
    return _roots[app]


def stored(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict[str, int]]:
    """``df`` read back from Parquet, and ``measures`` (aggregates), taken by the same job; ``rows`` is always among them."""
    spark, seen = df.sparkSession, Observation()
    path = f"{_root(spark)}/{uuid.uuid4().hex}"
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(name) for name, m in measures.items()])
    watched.write.parquet(path)
    found = seen.get
    return spark.read.schema(df.schema).parquet(path), {name: found.get(name) or 0 for name in ("rows", *measures)}
