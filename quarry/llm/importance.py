"""Importance resampling toward a target text: documents drawn by how much their words look like the target's.

Two passes over the documents, both in Arrow batches. The first counts hashed features: each task sums one vector of
``BUCKETS`` longs with ``np.bincount``, and ``treeReduce`` adds the vectors of all tasks in a tree, so the driver gets a
few vectors whatever the size of the data. From the counts of documents and target follows a gain for every bucket, a
vector of the same length, which the second pass broadcasts: it gathers the gains of a batch's features and sums them by
document with ``np.bincount``'s weights. The draw (Gumbel noise from a hash of the id, best scores first) is one order of
all documents by score, dealt by range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.order import placed
from quarry.llm.shared import stored

BUCKETS, LEAST_WORDS, SHARE, SEED = 10_000, 20, 10, "2024"
#: Words of a text are hashed in pieces of so many bytes; sums are made after so many words.
PIECE, HELD = 1 << 20, 1 << 18

_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[65:91] += 32
_KEEP[[b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]] = 32
_TABLE = _KEEP.tobytes()


def words(text: str) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, A-Z in lower case, piece by piece; all that isn't ASCII counts as a letter."""
    data, start = text.encode("utf-8", "surrogatepass").translate(_TABLE), 0
    while len(data) - start > PIECE:
        end = data.find(b" ", start + PIECE)
        if end < 0:
            break
        yield data[start:end].split()
        start = end
    yield data[start:].split()


def buckets(text: str | None) -> np.ndarray:
    """The bucket of every word of a text, repeats included."""
    parts = [np.fromiter(map(crc32, w), np.uint32, len(w)) for w in words(text)] if text else []
    return (np.concatenate(parts) % BUCKETS).astype(np.int32) if parts else np.zeros(0, np.int32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in batch.column("text"):
            total += np.bincount(buckets(text.as_py()), minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket is met in all texts."""
    parts = texts.select("text").mapInArrow(_counts, "v binary").rdd.map(lambda r: np.frombuffer(r.v, np.int64))
    return parts.treeReduce(np.add, depth=3) if parts.getNumPartitions() else np.zeros(BUCKETS, np.int64)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of target to source), a bucket."""
    n_s, n_t = float(source.sum()), float(target.sum())
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    ratio = [math.log((t + 1.0) * (n_s + BUCKETS) / ((s + 1.0) * (n_t + BUCKETS))) for s, t in pairs]
    return np.array([math.floor(1000 * r) for r in ratio], np.float64)


def _weights(gain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = gain.value
        for batch in batches:
            counts, sums, held, first, n = [], [], [], 0, 0
            for text in [*batch.column("text"), None]:
                if text is not None:
                    found = buckets(text.as_py())
                    counts.append(len(found))
                    held.append(found)
                    n += len(found)
                if held and (text is None or n >= HELD):
                    document = np.repeat(np.arange(len(held)), counts[first:])
                    # whole numbers below 2**53, so sums of doubles are exact
                    sums.append(np.bincount(document, value[np.concatenate(held)], len(held)))
                    held, first, n = [], len(counts), 0
            weight = np.concatenate(sums).astype(np.int64) if sums else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(weight)], ["doc_id", "n_features", "weight"]
            )

    return run


def noise(doc_id: Column) -> Column:
    """floor(1000 times a Gumbel draw) from the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), doc_id.cast("string")), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST_WORDS) -> DataFrame:
    """Per row: ``doc_id, n_features, weight, score, rank``; rank is null for rows that aren't drawn.

    Of the rows with at least ``least`` words, ``share`` percent are drawn, best score first, ties to the smaller id.

    Defined cases: null and empty texts have no features and weight 0; a null id has a null score and is never drawn; rows
    that share an id and a score are drawn in the order of their features and weight, each for itself; a very long text is
    hashed piece by piece; without target texts the gains only favour words that are rare in the documents; an empty table
    gives an empty result; further columns are ignored, whatever their names.
    """
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs), bucket_counts(target)))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_weights(gain), f"doc_id {id_type}, n_features long, weight long")
    rows = stored(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"))), "importance-scores")
    rows = rows.withColumn("_out", (F.col("n_features") < least) | F.col("score").isNull())
    order = [F.col("score").desc_nulls_last(), F.col("doc_id").asc(), F.col("n_features").asc(), F.col("weight").asc()]
    rows = placed(rows, ["_out"], order, "importance")
    drawn = ~F.col("_out") & (F.col("place") < F.floor(F.col("size") * share / 100))
    return rows.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("place") + 1).alias("rank"))


def drawn_rows(docs: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` whose id is drawn, with all their columns; rows that share a drawn id are all kept."""
    ids = resample(docs, target, share, least).filter("rank is not null").select(F.col("doc_id").alias("_drawn"))
    return docs.join(ids, F.col("doc_id") == F.col("_drawn"), "left_semi")


_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

SQL = rf"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS w FROM d),
bw AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
every AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
b AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2),
  lambda i: 16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS b FROM every, t),
s AS (SELECT b, count(*) AS s FROM dw JOIN b USING (w) GROUP BY b),
g AS (SELECT b, count(*) AS t FROM bw JOIN b USING (w) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM dw) + {BUCKETS}::DOUBLE)
  / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM bw) + {BUCKETS}::DOUBLE)))) AS BIGINT) AS gain FROM s FULL JOIN g USING (b)),
word_gain AS (SELECT w, gain FROM b JOIN gain USING (b)),
sums AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN word_gain USING (w) GROUP BY doc_id),
scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
  (CAST('0x' || sha256('{SEED}:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN sums USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS k,
  count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND k <= {SHARE} * n // 100 THEN k END AS rank FROM ranked
"""
