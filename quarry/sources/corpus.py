"""A software project as a DataFrame: ``scan_id, rel_path, language, text`` and what the file system knows.

``read_tree`` lists a directory with the binary-file source, so listing, filtering by path and length, decoding
and hashing run on the executors. ``read_zip`` reads an uploaded archive through ``archive``'s data source.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.config import CONFIG_SUFFIXES, DEFAULTS, GENERATED_DIRS, SKIPPED_DIRS, Settings

SCHEMA = "scan_id bigint, rel_path string, language string, text string"


def language_of(path: Column) -> Column:
    """python, java, config or null, by suffix or file name; suffixes are compared as they are written."""
    name = F.element_at(F.split(path, "/"), -1)
    config = F.lower(name).isin("dockerfile", ".env") | F.lit(False)
    for suffix in CONFIG_SUFFIXES:
        config = config | name.endswith(suffix)
    return F.when(name.endswith(".py") | name.endswith(".pyw"), "python").when(name.endswith(".java"), "java").when(config, "config")


def skipped(path: Column) -> Column:
    """True below a directory that is never walked, or any whose name begins with a dot."""
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1))
    return F.exists(dirs, lambda d: d.isin(*SKIPPED_DIRS) | d.startswith("."))


def _decode(content: pd.Series) -> pd.Series:
    def text(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for name in ("utf-8-sig", "gbk", "gb2312"):
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                continue
        return raw.decode("latin-1")

    return content.map(text)


def decoded(content: Column) -> Column:
    """UTF-8 with or without mark, GBK, GB 2312 or Latin-1: the first that reads the bytes. Spark's own decoder
    can't try a list of them."""
    return F.pandas_udf(_decode, "string")(content)


def collected(files: DataFrame, project: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Files of a project language ("python", "java", "multi") and its configuration, at most ``max_files`` by path.

    ``files``: rel_path, length and further columns. Order is by path, so that reruns agree. A .pyw file has a parser, but isn't
    collected.
    """
    wanted = {"python": ("python", "config"), "java": ("java", "config")}.get(project, ("python", "java", "config"))
    rows = files.filter(~skipped(F.col("rel_path")) & ~F.col("rel_path").endswith(".pyw") & (F.col("length") <= settings.max_bytes))
    rows = rows.withColumn("language", language_of(F.col("rel_path"))).filter(F.col("language").isin(*wanted))
    return rows.orderBy("rel_path").limit(settings.max_files)


def read_tree(spark: SparkSession, root: str, scan_id: int, project: str = "multi", settings: Settings = DEFAULTS) -> DataFrame:
    """The corpus below ``root``, with ``file_hash`` (SHA-256), ``bytes`` and ``newline_count``. Spark's file source passes over
    empty files; an archive's are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + base.replace(".", r"\.") + "/", "")
    return as_corpus(files.select(rel.alias("rel_path"), "length", "content"), scan_id, project, settings)


def as_corpus(files: DataFrame, scan_id: int, project: str = "multi", settings: Settings = DEFAULTS) -> DataFrame:
    """The corpus of files (rel_path, length, content): the wanted ones, decoded and hashed."""
    rows = collected(files, project, settings)
    text = decoded(F.col("content"))
    return rows.select(
        F.lit(scan_id).cast("bigint").alias("scan_id"),
        "rel_path",
        "language",
        text.alias("text"),
        F.sha2("content", 256).alias("file_hash"),
        F.col("length").alias("bytes"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("newline_count"),
    )


def dotted_files(files: DataFrame, languages: tuple[str, ...] = ("python", "java"), settings: Settings = DEFAULTS) -> DataFrame:
    """Files of the architecture scan (rel_path, length and further columns): Python and Java by suffix, whatever its case,
    outside of generated and hidden directories, at most ``go_max_bytes``; without a limit on their number."""
    suffix = F.lower(F.regexp_extract("rel_path", r"(\.[^./]*)$", 1))
    language = F.when(suffix == ".py", "python").when(suffix == ".java", "java")
    dirs = F.slice(F.split("rel_path", "/"), 1, F.size(F.split("rel_path", "/")) - 1)
    hidden = F.exists(dirs, lambda x: x.isin(*GENERATED_DIRS) | x.startswith("."))
    rows = files.filter(~hidden & (F.col("length") <= settings.go_max_bytes)).withColumn("language", language)
    return rows.filter(F.col("language").isin(*languages))


def read_zip(spark: SparkSession, archive: str, scan_id: int, project: str = "multi") -> DataFrame:
    from quarry.sources.archive import read_archive

    return read_archive(spark, archive, scan_id, project)


def from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A corpus of (scan_id, rel_path, language, text) rows."""
    return spark.createDataFrame(rows, SCHEMA)
