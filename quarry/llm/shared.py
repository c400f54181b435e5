"""Places and small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One ASCII white-space run; words are what stands between such runs.
SPACE = r"[\x20\x09-\x0D]+"

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: under ``spark.checkpoint.dir``, which all nodes see.

    Only where that setting is absent (tests in one process) a temporary folder is chosen.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = spark.sparkContext.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="quarry-")
            spark.conf.set("spark.checkpoint.dir", base)
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(base)
        _roots[app] = root = f"{base.rstrip('/')}/tables-{app}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        conf = spark.sparkContext._jsc.hadoopConfiguration()

        def clean() -> None:
            try:
                path.getFileSystem(conf).delete(path, True)
            except Exception:  # the JVM is gone already; the folder goes with the checkpoint folder
                pass

        atexit.register(clean)
    return _roots[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it again.

    The lineage ends there, so a lost executor costs a re-read and no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tables-" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def held_out(doc_id: Column, remainder: int = 2) -> Column:
    """True for the rows whose crc32 of the id, as text, leaves ``remainder`` modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == remainder, F.lit(False))
