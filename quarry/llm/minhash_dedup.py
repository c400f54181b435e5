"""Near-duplicates: universal-hash minima, banding, verification, and components.

1. One pass over the texts hashes each document's distinct word shingles, keeps their number, a digest of the set,
   ``HASHES`` minima (one byte of each for the estimate) and a key for each band of ``ROWS`` minima.
2. Documents of equal sets form a class; the least ``doc_id`` stands for it. Copies cost nothing further: the rows meet their
   class again only for the verdict, large classes by a broadcast of at most ``HOT`` rows.
3. Bands are joined by key. A pair of similarity 0.8 shares none of the ``BANDS`` bands with probability 5e-6.
4. Links are confirmed in rounds, each first on the minima (a margin of 5 standard deviations), then on the full sets.
   Star rounds compare each class with one centre of its buckets, which settles most of a dense group with one pair per
   class. Buckets that hold several components after that are unsettled. In those of up to ``SMALL`` classes the pairs
   across components are formed and confirmed. In larger ones the classes outside the bucket's largest component are
   compared with all others: both are dealt into blocks of about ``BLOCK`` classes, a task holds two blocks at a time,
   and only links that join components leave it. Nothing is capped, and no list of pairs is ever made.
5. Large-star/small-star over the confirmed links gives the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.shared import stored

HASHES, ROWS = 240, 6
BANDS = HASHES // ROWS
#: Least similarity in hundredths, of intersection to union.
SIMILAR = 80
#: Star rounds, the classes of an unsettled bucket of which pairs are formed, and those in a block of a larger one.
STARS, SMALL, BLOCK = 3, 8, 400
#: Classes of more than one in so many rows are joined by broadcast; there are at most so many.
HOT = 1000
_MATCHES = int(HASHES * 0.8 - 5 * (HASHES * 0.8 * 0.2) ** 0.5)

_rng = np.random.default_rng(20240501)
_A = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)
_BAND = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``k``-word shingles, A-Z lower-cased; of fewer words, one of them all.

    ``bytes.split`` and ``bytes.lower`` know ASCII white space and letters only, which is what is asked for.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size = min(k, n)
    h = w[: n - size + 1].copy()
    for i in range(1, size):
        h = h * _FOLD + w[i : n - size + 1 + i]
    return np.unique(_mixed(h + np.uint64(k - size)))


def minima(hashes: np.ndarray) -> np.ndarray:
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        part = _A[:, None] * x[None, i : i + 2048]
        part += _B[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    return _mixed((least.reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=1) + _SALT).view(np.int64)


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs, bands = [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), k)
                n.append(len(s))
                if not len(s):
                    keys.append(None), sigs.append(None), bands.append(None)
                    continue
                least = minima(s)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sigs.append((least * np.uint32(0x85EBCA6B) >> np.uint32(24)).astype(np.uint8).tobytes())
                bands.append(band_keys(least))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(sigs, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "key", "sig", "bands"],
            )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), k).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["id", "s"])

    return run


def _rough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose minima agree often enough."""
    for batch in batches:
        a, b = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sa", "sb")
        )
        yield batch.select(["u", "v"]).filter(pa.array((a == b).sum(axis=1) >= _MATCHES))


def _exact(similar: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                a, b = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = np.concatenate((a, b))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= similar * (len(a) + len(b) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, similar: int, id_type: str) -> DataFrame:
    """The links among ``pairs`` (u, v): sizes, then minima, then full sets. Stored."""
    schema = f"u {id_type}, v {id_type}"
    left = sigs.select(F.col("id").alias("u"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = sigs.select(F.col("id").alias("v"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    sized = pairs.join(left, "u").join(right, "v")
    sized = sized.filter(100 * F.least("na", "nb") >= similar * F.greatest("na", "nb"))
    near = stored(sized.select("u", "v", "sa", "sb").mapInArrow(_rough, schema), "near-pairs")
    full = near.join(sets.select(F.col("id").alias("u"), F.col("s").alias("sa")), "u")
    full = full.join(sets.select(F.col("id").alias("v"), F.col("s").alias("sb")), "v")
    return stored(full.select("u", "v", "sa", "sb").mapInArrow(_exact(similar), schema), "near-links")


def _labelled(rows: DataFrame, label: DataFrame | None) -> DataFrame:
    """Bucket rows with the component of each class so far."""
    if label is None:
        return rows.withColumn("comp", F.col("id"))
    joined = rows.join(label.withColumnRenamed("node", "id"), "id", "left")
    return joined.select(*rows.columns, F.coalesce("component", "id").alias("comp"))


def _unsettled(rows: DataFrame) -> DataFrame:
    """Rows of the buckets that hold more than one component, with the bucket's size, its largest component (``main``)
    and the number of classes outside that."""
    parts = rows.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
    open_ = parts.groupBy("band").agg(
        F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts")
    )
    open_ = open_.filter("parts > 1").select("band", "size", F.col("top.comp").alias("main"), F.col("top.n").alias("n_main"))
    return rows.join(open_, "band")


def _centre_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """One pair per class: with that centre of its buckets, of another component, that shares most of them."""
    if turn == 0:
        centres = rows.groupBy("band").agg(F.min(F.struct("id", "comp")).alias("c"))
    else:
        order: Column = F.xxhash64("id", F.lit(turn))
        centres = rows.groupBy("band").agg(F.min_by(F.struct("id", "comp"), order).alias("c"))
    pairs = rows.join(centres, "band").filter("comp <> c.comp").groupBy("id", "c.id").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.toDF("u", "v", "n").groupBy("u").agg(F.min(F.struct(-F.col("n"), F.col("v"))).alias("best"))
    return pairs.select("u", F.col("best.v").alias("v"))


def _small_pairs(rows: DataFrame) -> DataFrame:
    """The pairs across components in small unsettled buckets."""
    small = rows.filter(F.col("size") <= SMALL).select("band", F.col("id").alias("u"), "comp")
    other = small.select("band", F.col("u").alias("v"), F.col("comp").alias("other"))
    return small.join(other, "band").filter("u < v and comp <> other").select("u", "v").distinct()


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows of large unsettled buckets, dealt to pairs of blocks: ``band, a, b, across`` and the row's side.

    Blocks of the main component meet those of the rest (``across``), and the latter meet each other.
    """
    large = rows.filter(F.col("size") > SMALL).withColumn("rest", F.col("comp") != F.col("main"))
    n_rest = F.ceil((F.col("size") - F.col("n_main")) / BLOCK).cast("int")
    n_main = F.ceil(F.col("n_main") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("rest"), n_rest).otherwise(n_main).cast("long")).cast("int")
    large = large.select("*", mine.alias("mine"), n_rest.alias("n_rest"), n_main.alias("n_mains"))

    def meet(a, b, across, side):
        return F.struct(a.alias("a"), b.alias("b"), F.lit(across).alias("across"), F.lit(side).alias("side"))

    mine = F.col("mine")
    to_rest = F.transform(F.sequence(F.lit(0), F.col("n_rest") - 1), lambda y: meet(y, mine, True, 1))
    to_main = F.transform(F.sequence(F.lit(0), F.col("n_mains") - 1), lambda x: meet(mine, x, True, 0))
    among = F.transform(
        F.sequence(F.lit(0), F.col("n_rest") - 1), lambda y: meet(F.least(mine, y), F.greatest(mine, y), False, 0)
    )
    dealt = F.explode(F.when(F.col("rest"), F.concat(to_main, among)).otherwise(to_rest)).alias("x")
    return large.select("band", "id", "comp", dealt).select("band", "id", "comp", "x.a", "x.b", "x.across", "x.side")


def _find(root: dict, x):
    while root.get(x, x) != x:
        root[x] = root.get(root[x], root[x])
        x = root[x]
    return x


def block_links(ids, comps, sides, sizes, sigs: np.ndarray, sets: list[np.ndarray], across: bool, similar: int) -> list[tuple]:
    """Links that join components, among the rows of two blocks; ``across``: only from side 0 to side 1."""
    out, root = [], {}
    sizes, side = np.asarray(sizes), np.asarray(sides)
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    for i in range(len(ids)):
        if across and side[i]:
            continue
        js = np.flatnonzero(side == 1) if across else np.arange(i + 1, len(ids))
        if not len(js):
            continue
        fits = 100 * np.minimum(sizes[js], sizes[i]) >= similar * np.maximum(sizes[js], sizes[i])
        js = js[fits]
        agree = (sigs[js] == sigs[i]).sum(axis=1)
        js, agree = js[agree >= _MATCHES], agree[agree >= _MATCHES]
        js = js[np.argsort(-agree, kind="stable")]
        step = 16
        while len(js):
            mine = _find(root, comps[i])
            js = np.array([j for j in js if _find(root, comps[j]) != mine], dtype=np.int64)
            part, js = js[:step], js[step:]
            step *= 4
            for j in part:
                other = _find(root, comps[j])
                if other == _find(root, comps[i]):
                    continue
                s = flat[starts[j] : starts[j] + sizes[j]]
                at = np.minimum(np.searchsorted(sets[i], s), sizes[i] - 1)
                common = int((sets[i][at] == s).sum())
                if 100 * common >= similar * int(sizes[i] + sizes[j] - common):
                    out.append((ids[i], ids[j]))
                    root[other] = _find(root, comps[i])
    return out


def _block_tasks(similar: int, arrow_id: pa.DataType):
    """Streams rows sorted by their pair of blocks, one such group in memory at a time."""

    def links(rows: list[dict]) -> pa.RecordBatch:
        seen, unique = set(), []
        for r in rows:
            if r["id"] not in seen:
                seen.add(r["id"])
                unique.append(r)
        sets = [np.frombuffer(r["s"], np.uint64) for r in unique]
        sigs = np.frombuffer(b"".join(r["sig"] for r in unique), np.uint8).reshape(-1, HASHES)
        cols = [[r[c] for r in unique] for c in ("id", "comp", "side")]
        found = block_links(*cols, [len(x) for x in sets], sigs, sets, rows[0]["across"], similar)
        u, v = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, arrow_id), pa.array(v, arrow_id)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                k = (r["band"], r["a"], r["b"], r["across"])
                if k != key and held:
                    yield links(held)
                    held = []
                key = k
                held.append(r)
        if held:
            yield links(held)

    return run


def _large_links(rows: DataFrame, sigs: DataFrame, sets: DataFrame, similar: int, id_type: str) -> DataFrame:
    dealt = _blocks(rows).join(sigs.select("id", "sig"), "id").join(sets, "id")
    keys = ["band", "a", "b", "across"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)
    arrow_id = pa.string() if id_type == "string" else pa.int64()
    found = dealt.mapInArrow(_block_tasks(similar, arrow_id), f"u {'string' if id_type == 'string' else 'long'}, v {'string' if id_type == 'string' else 'long'}")
    found = found.select(F.col("u").cast(id_type).alias("u"), F.col("v").cast(id_type).alias("v")).distinct()
    return stored(found, "near-links")


def near_duplicates(docs: DataFrame, k: int = 5, similar: int = SIMILAR) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id`` (least id reachable over links), ``kept`` (it is that one).

    Defined cases: null, empty and blank texts have no shingles, are linked with nothing and kept; texts of fewer
    than ``k`` words are linked only with texts of the same words; very long texts are hashed whole, in time and memory linear in
    their words; ``similar`` below 80 is refused, as the bands would lose links; equal sets are linked whatever their
    order in the text; rows repeated with one id get the same verdict; an empty table gives an empty result; other
    columns are ignored.
    """
    if similar < SIMILAR:
        raise ValueError(f"bands and margins are those of a similarity of {SIMILAR} or more")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    features = stored(
        texts.mapInArrow(_features(k), f"doc_id {id_type}, n long, key binary, sig binary, bands array<long>"),
        "near-features",
    )
    whole = features.select("doc_id", "n", "key").filter("n > 0")
    # one row for each class, combined within the tasks first: all that follows works on these
    classes = whole.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes, "near-classes")
    reps = classes.select(F.col("rep").alias("id")).distinct()
    chosen = features.select(F.col("doc_id").alias("id"), "n", "sig", "bands").join(reps, "id", "left_semi")
    rows = chosen.select("id", F.explode("bands").alias("band")).distinct()
    shared = rows.join(rows.groupBy("band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("band"), "band")
    shared = stored(shared.select("id", "band"), "near-buckets")
    ids = stored(shared.select("id").distinct(), "near-ids")
    sigs = features.select(F.col("doc_id").alias("id"), "n", "sig").join(ids, "id", "left_semi").dropDuplicates(["id"])
    sigs = stored(sigs, "near-minima")
    wanted = texts.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    sets = stored(wanted.mapInArrow(_sets(k), f"id {id_type}, s binary").dropDuplicates(["id"]), "near-sets")
    label = None
    for turn in range(STARS + 1):
        open_rows = stored(_unsettled(_labelled(shared, label)), "near-open")
        if open_rows.isEmpty():
            break
        pairs = _centre_pairs(open_rows, turn) if turn < STARS else _small_pairs(open_rows)
        found = _confirmed(pairs, sigs, sets, similar, id_type)
        if turn == STARS:
            found = found.unionByName(_large_links(open_rows, sigs, sets, similar, id_type))
        if not found.isEmpty():
            # the components so far are stars already, so they stand for all links that made them
            known = [] if label is None else [label.select(F.col("node").alias("u"), F.col("component").alias("v"))]
            label = stored(components(reduce(DataFrame.unionByName, known, found)), "near-label")
    verdicts = classes.withColumn("component", F.lit(None).cast(id_type))
    if label is not None:
        verdicts = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    verdicts = stored(verdicts.select("key", "copies", F.coalesce("component", "rep").alias("component_id")), "near-verdicts")
    # at most HOT classes can have over one in HOT of all rows: their verdicts are sent, so that their rows are never dealt by key
    total = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = F.broadcast(verdicts.filter(F.col("copies") * HOT > total))
    rest = whole.join(hot.select("key"), "key", "left_anti").join(verdicts.filter(F.col("copies") * HOT <= total), "key")
    out = whole.join(hot, "key").unionByName(rest).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = features.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, k: int = 5, similar: int = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; the cases are those of ``near_duplicates``, and every row of an id
    that is kept stays."""
    kept = near_duplicates(docs, k, similar).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept_id")), "left_semi")
