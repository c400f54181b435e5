"""Toxicity by non-negative positive-unlabelled learning.

The training rows are confirmed toxic documents and unlabelled text (documents of any kind, toxic or not). With the class prior ``pi`` the risk of a classifier g is
``pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)])`` for the logistic loss l: the second part is the risk on
negatives, corrected for the positives hidden in the unlabelled text, and kept from going below zero, where a
flexible model would only overfit. g is linear in the presence of words and word beginnings and is trained with numpy.

Bounds, both documented parameters: ``POSITIVE`` and ``UNLABELLED`` training documents, chosen by a hash of the id, and
``VOCABULARY`` features. Scores read whole texts of all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import held_out, stored

POSITIVE, UNLABELLED, VOCABULARY = 4000, 12000, 1500
#: Least positive documents that a feature must stand in, and the threshold of a positive verdict.
SUPPORT, CUT = 6, 0.3
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Distinct words in lower case, and beginnings of four to six letters of longer words, marked by "*"."""
    words = set(_WORD.findall(text.lower())) if text else set()
    out = set(words)
    for k in (4, 5, 6):
        out.update([w[:k] + "*" for w in words if len(w) > k])
    return out


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, documents, positive documents) of a batch."""
    for batch in batches:
        seen: dict[str, list[int]] = {}
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
            for f in features(text):
                both = seen.setdefault(f, [0, 0])
                both[0] += 1
                both[1] += y
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*seen], pa.string()),
                pa.array([v[0] for v in seen.values()], pa.int64()),
                pa.array([v[1] for v in seen.values()], pa.int64()),
            ],
            ["f", "n", "p"],
        )


def _indices(vocabulary: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                sorted(vocabulary[f] for f in features(t) & vocabulary.keys()) for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "y", "x"]
            )

    return run


def train_nnpu(
    x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 3e-4
) -> tuple[np.ndarray, float]:
    """Weights and bias; ``x`` has a row of 0/1 features per document, ``positive`` marks the confirmed ones.

    Full-batch Adam; a feature may only raise the score, so length alone can't hide a toxic term. While the corrected risk on negatives is below zero, the step climbs that part instead.
    """
    p, u = x[positive].astype(np.float32), x[~positive].astype(np.float32)
    w, m, v = (np.zeros(x.shape[1] + 1) for _ in range(3))
    w[-1] = np.log(prior / (1 - prior))

    def grad(rows: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(slope.astype(np.float32) @ rows / max(1, len(rows)), slope.mean() if len(slope) else 0.0)

    for t in range(1, steps + 1):
        gp, gu = p @ w[:-1].astype(np.float32) + w[-1], u @ w[:-1].astype(np.float32) + w[-1]
        sp, su = 1 / (1 + np.exp(-np.clip(gp, -30, 30))), 1 / (1 + np.exp(-np.clip(gu, -30, 30)))
        below = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean() if len(gu) and len(gp) else 0.0
        as_negative = grad(u, su) - prior * grad(p, sp)
        g = prior * grad(p, sp - 1) + as_negative if below >= 0 else -as_negative
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        np.maximum(w[:-1], 0, out=w[:-1])
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], float]:
    """Feature weights and bias. Labels are read only of rows that are not held out."""
    known = labels.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = stored(known, "toxic-known")
    n, n_pos = known.agg(F.count("toxic"), F.coalesce(F.sum((F.col("toxic") == 1).cast("int")), F.lit(0))).first()
    if not n_pos:
        return {}, -3.0
    prior = min(0.9, max(1e-3, n_pos / n))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = known.filter("toxic = 1").select("doc_id").orderBy(order, "doc_id").limit(POSITIVE).withColumn("y", F.lit(1))
    # the unlabelled part is drawn from all documents, toxic ones included: the prior is their share in it
    pool = docs.select("doc_id").filter(~held_out(F.col("doc_id"))).distinct()
    other = pool.orderBy(order, "doc_id").limit(UNLABELLED).withColumn("y", F.lit(0))
    ids = F.broadcast(stored(chosen.unionByName(other), "toxic-ids"))
    sample = stored(docs.select("doc_id", "text").join(ids, "doc_id"), "toxic-sample")
    counts = sample.mapInArrow(_document_counts, "f string, n long, p long").groupBy("f").agg(
        F.sum("n").alias("n"), F.sum("p").alias("p")
    )
    sizes = dict(sample.groupBy("y").count().collect())
    pos, all_ = sizes.get(1, 0), sum(sizes.values())
    ratio = F.log((F.col("p") + 0.5) / pos) - F.log((F.col("n") - F.col("p") + 1.0) / max(1, all_ - pos))
    # evidence: the log-odds, times the root of the support
    ranked = counts.filter(F.col("p") >= SUPPORT).withColumn("e", ratio * F.sqrt("p")).filter("e > 0")
    top = ranked.orderBy(F.desc("e"), "f").limit(VOCABULARY).collect()
    vocabulary = {r.f: i for i, r in enumerate(top)}
    ids_as_text = sample.select(F.col("doc_id").cast("string").alias("doc_id"), "y", "text")
    rows = ids_as_text.mapInArrow(_indices(vocabulary), "doc_id string, y int, x array<int>")
    rows = sorted(rows.collect(), key=lambda r: (r.doc_id, r.y))
    x = np.zeros((len(rows), len(vocabulary)), np.uint8)
    for i, r in enumerate(rows):
        x[i, r.x] = 1
    w, bias = train_nnpu(x, np.array([r.y == 1 for r in rows]), prior)
    least = 0.1 * w.max() if len(w) else 0.0  # the many small weights are noise that adds up in long texts
    return {f: float(round(w[i], 6)) for f, i in vocabulary.items() if w[i] > max(least, 1e-3)}, bias


def _scores(weights: dict[str, float], bias: float):
    words = {f: w for f, w in weights.items() if f[-1] != "*"}
    starts = {k: {f[:-1]: w for f, w in weights.items() if f[-1] == "*" and len(f) == k + 1} for k in (4, 5, 6)}
    begin = {f for s in starts.values() for f in s}
    first4 = {f[:4] for f in begin}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column("text"):
                g, text = bias, value.as_py()
                if text:
                    found = set(_WORD.findall(text.lower()))
                    g += sum(words[f] for f in sorted(found & words.keys()))
                    likely = [w for w in found if w[:4] in first4]
                    for k in (4, 5, 6):
                        of = starts[k]
                        g += sum(of[f] for f in sorted({w[:k] for w in likely if len(w) > k} & of.keys()))
                out.append(1 / (1 + np.exp(-min(30.0, max(-30.0, g)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted``.

    Defined cases: a null or empty text has the score of the bias alone; without confirmed toxic rows outside the
    held-out part all scores are that of a fixed low bias; null labels don't count, and of several labels of one id the
    largest does; rows repeated with one id are scored each; an empty table gives an empty result; other columns are
    ignored (language, source and id are no inputs).
    """
    weights, bias = fit(docs, labels)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(_scores(weights, bias), f"doc_id {id_type}, score double")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )
