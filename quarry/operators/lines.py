"""Lines and their counts: pure column expressions over the text, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Universal line ends.
ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
BLANK = r"^[\s\x1C-\x1F\x85 ]*$"


def once(value: Column) -> Column:
    """A value that is made once a row, however often it is read: filters are not pushed below ``explode``, which would make it anew at
    each use. To be selected under an alias, one in a select."""
    return F.explode(F.array(value))


def line_array(text: Column) -> Column:
    """The lines of a text, which is split once; an end at its end starts no further line."""

    def told(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

    return F.get(F.transform(F.array(F.split(F.coalesce(text, F.lit("")), ENDS, -1)), told), F.lit(0))


def _lines_of(corpus: DataFrame) -> Column:
    """A text's lines: ``ls`` where the corpus holds them already."""
    return F.col("ls") if "ls" in corpus.columns else line_array(F.col("text"))


def lines(corpus: DataFrame, *keep: str) -> DataFrame:
    """One row per line: scan_id, rel_path, language, line_no (from 1), raw, and the columns of ``keep``."""
    rows = corpus.select("scan_id", "rel_path", "language", *keep, F.posexplode(_lines_of(corpus)))
    return rows.select("scan_id", "rel_path", "language", *keep, (F.col("pos") + 1).alias("line_no"), F.col("col").alias("raw"))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def is_code(raw: Column, language: Column) -> Column:
    """Counts as code by its own: not blank, and in Python no comment line."""
    return ~raw.rlike(BLANK) & ~((language == "python") & raw.rlike(r"^\s*#"))


def java_code_lines(all_lines: Column) -> Column:
    """Lines of code of a Java text: a fold over its lines carries whether a block comment is open.

    A line that begins a block comment, or lies in one, is no code as a whole.
    """
    start = F.struct(F.lit(False).alias("open"), F.lit(0).alias("n"))

    def step(s: Column, raw: Column) -> Column:
        x = strip(raw)
        ends = x.contains("*/")
        opens = ~s["open"] & x.startswith("/*")
        counts = ~s["open"] & ~opens & ~x.startswith("//") & ~raw.rlike(BLANK)
        return F.struct(((s["open"] | opens) & ~ends).alias("open"), (s["n"] + counts.cast("int")).alias("n"))

    return F.aggregate(all_lines, start, step, lambda s: s["n"])


def loc(corpus: DataFrame) -> DataFrame:
    """scan_id, rel_path, language, total_lines, loc."""
    all_lines = _lines_of(corpus)
    plain = F.size(F.filter(all_lines, lambda x: is_code(x, F.col("language"))))
    return corpus.select(
        "scan_id",
        "rel_path",
        "language",
        F.size(all_lines).alias("total_lines"),
        F.when(F.col("language") == "java", java_code_lines(all_lines)).otherwise(plain).alias("loc"),
    )
