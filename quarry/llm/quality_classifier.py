"""Quality by hierarchical empirical Bayes over documents, paths and hosts.

Evidence of a document: a logistic classifier over plain text statistics, trained with numpy on at most ``SAMPLE``
labelled documents (chosen by a hash of the id). Sites add prior knowledge: a host's posterior is the mean of its
documents' probabilities shrunk toward the global mean, a path's that of its documents shrunk toward the host's
posterior. How strongly is estimated from all documents by the method of moments (within-group over between-group
variance, by grouped sums), so sparse sites say little and large, distinct ones much. A document's final log-odds
are its own plus what its path (without the document itself) says beyond the global mean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import stored

SAMPLE = 12_000
#: Of the labelled good documents, the share that the cutoff on the final score may reject at most.
GOOD_LOST = 0.003
#: Most pseudo-documents of a prior, and most log-odds that a site can add or take.
MOST_PRIOR, MOST_SHIFT = 1e4, 2.0

_SYMBOLS = re.compile(r"[#*$%&|<>{}\[\]\\^~=_]")
_STOPS = re.compile(r"[!?]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
N_FEATURES = 12


def features(text: str | None) -> list[float]:
    """Text statistics, scaled to about one."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * (N_FEATURES - 1) + [1.0]
    chars = len(text)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    runs = sum(map(str.__eq__, words, words[1:]))
    return [
        log(1 + n) / 5,
        min(3.0, chars / n / 6),
        len(_SYMBOLS.findall(text)) / n,
        len(_STOPS.findall(text)) / n,
        len(_UPPER.findall(text)) / chars * 5,
        len(_DIGIT.findall(text)) / chars * 5,
        distinct / n,
        pairs / max(1, n - 1),
        runs / n,
        1 - len(set(lines)) / max(1, len(lines)),
        text.count(".") / n * 3,
        0.0,
    ]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [features(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("good"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "good", "x"]
        )


def expand(x: np.ndarray) -> np.ndarray:
    """The statistics, their squares and products, so that a linear model can bend."""
    i, j = np.triu_indices(x.shape[1])
    return np.hstack([x, x[:, i] * x[:, j]])


def train(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 0.3) -> np.ndarray:
    """Weights of a ridge logistic regression with the bias last, classes weighted equally, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    weight = np.where(y > 0.5, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + penalty * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """Standardisation and weights; without labels of both classes every document has even odds."""

    def __init__(self, rows: list[tuple[list[float], int]]):
        x = np.array([r[0] for r in rows], float).reshape(len(rows), N_FEATURES)
        y = np.array([r[1] for r in rows], float)
        self.use = bool(len(y) and 0 < y.sum() < len(y))
        if self.use:
            z = expand(x)
            self.mean, self.std = z.mean(axis=0), z.std(axis=0) + 1e-6
            self.w = train((z - self.mean) / self.std, y)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        if not self.use or not len(x):
            return np.zeros(len(x))
        z = np.clip((expand(x) - self.mean) / self.std, -8, 8)
        return np.clip(z @ self.w[:-1] + self.w[-1], -12, 12)


def _evidence(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("text")], float).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "host", "path")] + [pa.array(model.log_odds(x), pa.float64())],
                ["doc_id", "host", "path", "evidence"],
            )

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    known = labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    # both classes get a part of the bound
    order = F.xxhash64(F.col("doc_id").cast("string"))
    parts = [known.filter(F.col("good") == g).orderBy(order, "doc_id").limit(SAMPLE // 2) for g in (0, 1)]
    ids = F.broadcast(stored(parts[0].unionByName(parts[1]), "quality-ids"))
    sample = docs.select("doc_id", "text").join(ids, "doc_id")
    sample = sample.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("good").cast("int").alias("good"), "text")
    rows = sample.mapInArrow(_rows, "doc_id string, good int, x array<double>").collect()
    return Model([(r.x, r.good) for r in sorted(rows, key=lambda r: (r.doc_id, r.x))])


def _log_odds(p: Column) -> Column:
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame) -> float:
    """Pseudo-documents of the prior: variance within groups over that between them. ``groups``: n, s, q (sum, squares)."""
    total = groups.agg(
        F.sum("n"), F.sum("s"), F.sum("q"), F.count(F.lit(1)), F.sum(F.col("s") * F.col("s") / F.col("n")),
        F.sum(F.col("n").cast("double") * F.col("n")),
    ).first()
    n, s, q, k, between, squares = (float(v or 0) for v in total)
    if k < 2 or n <= k:
        return MOST_PRIOR
    within = max(1e-9, (q - between) / (n - k))
    tau = ((between - s * s / n) - (k - 1) * within) / max(1e-9, n - squares / n)
    return MOST_PRIOR if tau <= within / MOST_PRIOR else within / tau


def quality(
    docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None
) -> DataFrame:
    """Per document: ``doc_id, host, path, evidence, prior, score, kept``; scores are probabilities of good quality.

    ``host`` and ``path`` default to the source, and the language within it. Defined cases: null and empty texts have
    the statistics of no words; null hosts and paths are groups of their own; without labels of both classes
    all evidence is even and everything is kept; a document alone in its path and host has the global prior; rows
    repeated with one id are scored each; an empty table gives an empty result; other columns are ignored.
    """
    model = fit(docs, labels)
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(
        "doc_id",
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
        "text",
    )
    rows = rows.mapInArrow(_evidence(model), f"doc_id {id_type}, host string, path string, evidence double")
    rows = stored(rows, "quality-evidence").withColumn("p", 1 / (1 + F.exp(-F.col("evidence"))))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")]
    paths = stored(rows.groupBy("host", "path").agg(*sums), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    n, s = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0.0))).first()
    mean = s / n if n else 0.5
    k_host, k_path = _strength(hosts), _strength(paths)
    sites = paths.join(hosts.select("host", F.col("n").alias("hn"), F.col("s").alias("hs")), "host")
    joined = rows.join(sites, ["host", "path"])
    # each posterior leaves the document itself out
    of_host = (F.col("hs") - F.col("p") + k_host * mean) / (F.col("hn") - 1 + k_host)
    of_path = (F.col("s") - F.col("p") + k_path * of_host) / (F.col("n") - 1 + k_path)
    shift = _log_odds(of_path) - float(log(max(1e-6, mean) / max(1e-6, 1 - mean)))
    shift = F.least(F.lit(MOST_SHIFT), F.greatest(F.lit(-MOST_SHIFT), shift))
    scored = stored(
        joined.select(
            "doc_id", "host", "path", "evidence", of_path.alias("prior"), (F.col("evidence") + shift).alias("odds")
        ),
        "quality-scores",
    )
    cut = _cutoff(scored, labels) if model.use else float("-inf")
    return scored.select(
        "doc_id",
        "host",
        "path",
        "evidence",
        "prior",
        (1 / (1 + F.exp(-F.col("odds")))).alias("score"),
        (F.col("odds") >= F.lit(cut)).alias("kept"),
    )


def _cutoff(scored: DataFrame, labels: DataFrame) -> float:
    """The largest log-odds on a grid of 1/8, at most 0, below which at most ``GOOD_LOST`` of the good documents are."""
    good = labels.filter("quality = 1").select("doc_id").distinct()
    bins = scored.join(good, "doc_id", "left_semi").groupBy(F.floor(F.col("odds") * 8).cast("int").alias("b")).count()
    # odds are clipped, so there are at most a few hundred bins
    rows = [tuple(r) for r in bins.collect()]
    most = GOOD_LOST * sum(n for _, n in rows)
    return max(c for c in range(-8 * 16, 1) if sum(n for b, n in rows if b < c) <= most) / 8


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose documents are kept, with all their columns."""
    kept = quality(docs, labels, **options).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept_id")), "left_semi")
