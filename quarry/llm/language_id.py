"""Language identification with a string kernel.

The kernel of two texts is the cosine of their presence vectors over a blended spectrum: all runs of one to ``LONGEST``
characters of their words, a word's borders included, each counted once. Presence is kept in ``WIDTH`` hashed places, so
that every vector has one bound whatever the scripts are. Learning has a Nyström approximation: ``LANDMARKS`` texts,
dealt evenly over the languages, span the space; kernel ridge regression, one language against the rest, is solved in
that span from a sample of ``SAMPLE`` labelled rows, dealt evenly likewise, of which only rows of ``LANDMARKS`` numbers
reach the driver. Scoring multiplies the presence matrix of a batch with that of the landmarks, and the kernel rows that
come out with the dual weights.

Bounds, both documented parameters: ``SAMPLE`` and ``LANDMARKS``. Whole texts are read throughout. A language is a value
of the ``lang`` column; there must be few enough of them to be listed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.shared import held_out, stored

SAMPLE, LANDMARKS, LONGEST, WIDTH, RIDGE = 4000, 240, 3, 1 << 15, 1e-3
#: Rows whose presence is multiplied at once, and characters of a text that are hashed at once.
ROWS, PIECE = 64, 1 << 20
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
#: Odd multipliers of the hash, one for each length of a run.
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def places(text: str | None) -> np.ndarray:
    """The hashed places of a text's runs, sorted; none if it has no letter."""
    seen = np.zeros(WIDTH, bool)
    held: list[str] = []
    size = 0
    for word in _WORD.finditer(text or ""):
        held.append(word.group().lower())
        size += len(held[-1]) + 1
        if size > PIECE:
            _mark(seen, held)
            held, size = [], 0
    _mark(seen, held)
    return np.flatnonzero(seen).astype(np.int32)


def _mark(seen: np.ndarray, words: list[str]) -> None:
    if words:
        # a longer run than a word's end may cross the border into the next word; that is left out
        codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        border, crossing, state = codes == 32, np.zeros(len(codes), bool), np.zeros(len(codes), np.uint32)
        for k in range(LONGEST):
            n = len(codes) - k
            state = (state[:n] + codes[k:]) * _FACTORS[k]
            state ^= state >> np.uint32(15)
            # inner borders: between the first and the last character of the run
            crossing = crossing[:n] | (border[k - 1 : k - 1 + n] if k > 1 else False)
            alone = border[:n] if k == 0 else False
            seen[(state[~(crossing | alone)] * _FACTORS[-1 - k]) >> np.uint32(32 - 15)] = True


def kernel(rows: list[np.ndarray], columns: np.ndarray, landmarks: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Kernel values of texts (as places) and landmarks: one matrix product of presences, over both norms.

    ``columns`` gives each place its row of ``landmarks``, or -1 where no landmark has it.
    """
    present = np.zeros((len(rows), len(landmarks)), np.float32)
    for i, r in enumerate(rows):
        c = columns[r]
        present[i, c[c >= 0]] = 1
    own = np.sqrt(np.array([max(1, len(r)) for r in rows], np.float64))
    return (present @ landmarks) / (own[:, None] * norms)


class Model:
    """Landmarks and dual weights; what tasks get is bounded by ``WIDTH`` and ``LANDMARKS``."""

    def __init__(self, langs: list[str], landmarks: list[np.ndarray]):
        self.langs = langs
        present = np.zeros((WIDTH, len(landmarks)), np.float32)
        for j, p in enumerate(landmarks):
            present[p, j] = 1
        used = np.flatnonzero(present.any(axis=1))
        self.columns = np.full(WIDTH, -1, np.int32)
        self.columns[used] = np.arange(len(used))
        self.landmarks = present[used]
        self.norms = np.sqrt(np.array([max(1, len(p)) for p in landmarks], np.float64))
        self.own = kernel(landmarks, self.columns, self.landmarks, self.norms)
        self.dual = np.zeros((len(landmarks), len(langs)))
        self.bias = np.zeros(len(langs))

    def rows(self, texts: list[np.ndarray]) -> np.ndarray:
        return kernel(texts, self.columns, self.landmarks, self.norms)

    def learn(self, k: np.ndarray, lang: np.ndarray) -> None:
        """Ridge regression of +1 and -1 a language, in the space that the landmarks span; languages weigh alike."""
        values, vectors = np.linalg.eigh(self.own)
        kept = values > 1e-8 * values.max()
        root = vectors[:, kept] / np.sqrt(values[kept])
        x = np.hstack([k @ root, np.ones((len(k), 1))])
        y = 2.0 * (lang[:, None] == np.arange(len(self.langs))) - 1.0
        weight = 1.0 / np.bincount(lang, minlength=len(self.langs)).clip(1)[lang]
        weight *= len(lang) / weight.sum()
        penalty = RIDGE * len(lang) * np.eye(x.shape[1])
        penalty[-1, -1] = 0
        solved = np.linalg.lstsq((x.T * weight) @ x + penalty, (x.T * weight) @ y, rcond=None)[0]
        self.dual, self.bias = root @ solved[:-1], solved[-1]

    def predict(self, texts: list[np.ndarray]) -> list[tuple[str, float]]:
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        values = self.rows(texts) @ self.dual + self.bias
        best = values.argmax(axis=1)
        scores = np.clip((values[np.arange(len(texts)), best] + 1) / 2, 0, 1)
        return [(self.langs[b], float(s)) if len(t) else (UNKNOWN, 0.0) for b, s, t in zip(best, scores, texts, strict=True)]


def _batches(values, size: int = ROWS) -> Iterator[list[np.ndarray]]:
    held: list[np.ndarray] = []
    for v in values:
        held.append(places(v.as_py()))
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _kernel_rows(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            out = [r.tobytes() if len(p) else None for part in _batches(batch.column("text")) for r, p in zip(m.rows(part), part, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(out, pa.binary())], ["lang", "k"])

    return run


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            out = [p for part in _batches(batch.column("text")) for p in m.predict(part)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([p[0] for p in out], pa.string()), pa.array([p[1] for p in out], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return run


def _drawn(rows: DataFrame, langs: list[Row], most: int) -> DataFrame:
    """About ``most`` of the rows, as evenly over the languages as there are rows; a hash of the id decides.

    A threshold on the hash leaves somewhat more than each language's part, so that only these are ordered.
    """
    part = max(1, most // max(1, len(langs)))
    limits = {r.lang: min(1.0, (1.5 * part + 30) / r.n) for r in langs}
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("lang")]
    h = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string")), F.lit(1 << 30)) / (1 << 30)
    order = W.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text"))
    chosen = rows.withColumn("h", h).filter(F.col("h") < limit).withColumn("k", F.row_number().over(order))
    return chosen.filter(F.col("k") <= part)


def _as_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [p.tobytes() for part in _batches(batch.column("text")) for p in part]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(out, pa.binary())], ["lang", "p"])


def fit(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """The model of the rows with a language and a letter that are not held out."""
    known = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}")
    )
    langs = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    if not langs:
        return Model([], [])
    spark = docs.sparkSession
    rows = stored(_drawn(known, langs, sample).select("lang", "text", "k"), "language-sample")
    first = rows.filter(F.col("k") <= max(1, landmarks // len(langs))).select("lang", "text", "k")
    first = first.orderBy("lang", "k").select("lang", "text").mapInArrow(_as_places, "lang string, p binary").collect()
    marks = [p for p in (np.frombuffer(r.p, np.int32) for r in first) if len(p)]
    names = [r.lang for r in langs]
    if not marks:
        return Model([], [])
    model = Model(names, marks)
    shared = spark.sparkContext.broadcast(model)
    found = rows.orderBy("lang", "k").select("lang", "text").mapInArrow(_kernel_rows(shared), "lang string, k binary").filter("k is not null").collect()
    number = {name: i for i, name in enumerate(names)}
    model.learn(np.stack([np.frombuffer(r.k, np.float64) for r in found]), np.array([number[r.lang] for r in found]))
    return model


def identify(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, held_out, lang_pred, score``.

    Defined cases: a text that is null, empty or without a letter is ``und`` with score 0, and so is every text where
    nothing can be learned; of equal scores the first language by name wins; a language with few rows takes part with
    all of them; a row whose ``lang`` is null is predicted, not learned from; rows that share an id are predicted each; a
    very long text is read whole, piece by piece; an empty table gives an empty result; further columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_scored(model), f"doc_id {id_type}, lang_pred string, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
