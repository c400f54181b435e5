"""The Merkle manifest, the importance draw and language identification against plain loops."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import importance, language_id, merkle_manifest
from quarry.llm.order import placed


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def all_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return levels


def way_up(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 3 * 3 : i // 3 * 3 + 3]
        out.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        i //= 3
    return out


def plain_manifest(docs):
    by = {}
    for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect():
        d, s, lang, n, text = r
        leaf = digest(*map(field, (d, s, lang, n, text)))
        bad = d is not None and text is not None and zlib.crc32(str(d).encode()) % 2 == 0
        other = digest(*map(field, (d, s, lang, n, text.replace("\n", "") if bad else text)))
        by.setdefault(s, []).append((d, leaf, other))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = all_levels([r[1] for r in by[s]])
    top = all_levels([trees[s][-1][0] for s in sources])
    rows = []
    for k, s in enumerate(sources):
        for i, (d, leaf, other) in enumerate(by[s]):
            steps = way_up(trees[s], i) + way_up(top, k)
            node = other
            for left, right in steps:
                node = digest(left, node, right)
            rows.append((d, leaf, trees[s][-1][0], top[-1][0], digest("".join(x + y for x, y in steps)), node, node == top[-1][0]))
    return sorted(rows, key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


@pytest.fixture(scope="module")
def many(docs_of):
    """One source over several blocks, one of exactly a block, some of one to four rows; line feeds here and there."""
    rows = [(i, f"text {i}\nline" if i % 5 == 0 else f"text {i}", "en", "hot") for i in range(2 * merkle_manifest.BLOCK + 5)]
    rows += [(10_000 + i, f"other {i}\r\n{i}", None, "block") for i in range(merkle_manifest.BLOCK)]
    rows += [(20_000 + i, "x\ny" * i, "de", f"s{i % 4 + i % 3}é") for i in range(11)]
    return docs_of(rows)


def test_manifest_equals_loop(many):
    got = rows_of(merkle_manifest.manifest(many))
    assert got == plain_manifest(many)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_over_three_rounds(many, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "DEPTH", 2)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 9)
    assert rows_of(merkle_manifest.manifest(many)) == plain_manifest(many)


def test_manifest_equals_sql(many):
    documents = many.select("doc_id", "text", "lang", "source", "n_chars").toPandas()
    with duckdb.connect() as con:
        con.register("documents", documents)
        want = con.execute(merkle_manifest.SQL).fetchall()
    assert rows_of(merkle_manifest.manifest(many)) == sorted(want, key=str)


def test_manifest_awkward(awkward, empty, docs_of):
    assert rows_of(merkle_manifest.manifest(awkward)) == plain_manifest(awkward)
    assert merkle_manifest.manifest(empty).count() == 0
    nulls = docs_of([(None, "a\nb", None, None), (None, None, "en", "x"), (1, "", "en", "x"), (1, None, "en", "x")])
    assert rows_of(merkle_manifest.manifest(nulls)) == plain_manifest(nulls)
    alone = docs_of([(7, "only", "en", "x")])
    (row,) = merkle_manifest.manifest(alone).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == digest("")


def test_places_in_groups(spark):
    rows = [(g, v) for g, n in (("a", 700), ("b", 1), (None, 3), ("c", 40)) for v in range(n)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    got = placed(df, ["g"], [F.col("v").desc()], "test-places").collect()
    sizes = {"a": 700, "b": 1, None: 3, "c": 40}
    assert len(got) == len(rows) and all(r.place == sizes[r.g] - 1 - r.v and r.size == sizes[r.g] for r in got)
    assert sorted(r.place for r in placed(df, [], [F.col("g").asc(), F.col("v").asc()], "test-places").collect()) == [*range(744)]


def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_draw(docs, target):
    def bucket(w):
        return zlib.crc32(w.encode()) % 10000

    rows = [(r.doc_id, plain_words(r.text)) for r in docs.select("doc_id", "text").collect()]
    s, t = [0] * 10000, [0] * 10000
    for _, ws in rows:
        for w in ws:
            s[bucket(w)] += 1
    for r in target.collect():
        for w in plain_words(r.text):
            t[bucket(w)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    out = []
    for d, ws in rows:
        h = int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(w)] for w in ws)
        out.append([d, len(ws), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted([r for r in out if r[1] >= 20], key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able[: 10 * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


@pytest.fixture(scope="module")
def target(spark):
    texts = ["The old house on the hill", "Ein Haus, é und 42 Ünder", None, ""]
    return spark.createDataFrame([*enumerate(texts)], "item_id bigint, text string")


@pytest.fixture(scope="module")
def mixed(docs_of):
    rng = np.random.default_rng(4)
    words = np.array(["the", "House", "on", "hill", "é", "Ünder", "x1", "42", "noise", "K", "plain", "-", "a_b", "don't"])
    return docs_of([(i, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(400)])


def test_draw_equals_loop(mixed, target):
    got = rows_of(importance.resample(mixed, target))
    assert got == plain_draw(mixed, target)
    assert sum(r[4] is not None for r in got) > 20


def test_draw_equals_sql(mixed, target):
    with duckdb.connect() as con:
        con.register("documents", mixed.select("doc_id", "text").toPandas())
        con.register("benchmark", target.toPandas())
        want = con.execute(importance.SQL).fetchall()
    assert rows_of(importance.resample(mixed, target)) == sorted(want, key=str)


def test_draw_awkward(awkward, empty, target, docs_of, monkeypatch):
    assert rows_of(importance.resample(awkward, target)) == plain_draw(awkward, target)
    monkeypatch.setattr(importance, "PIECE", 100)
    monkeypatch.setattr(importance, "HELD", 50)
    assert rows_of(importance.resample(awkward, target)) == plain_draw(awkward, target)
    assert importance.resample(empty, target).count() == 0
    assert importance.resample(awkward, target.limit(0)).count() == awkward.count()
    (row,) = importance.resample(docs_of([(None, "a " * 30)]), target).collect()
    assert row.n_features == 30 and row.score is None and row.rank is None
    ties = docs_of([(5, "the hill " * 20)] * 30)
    assert sorted(r.rank for r in importance.resample(ties, target).collect() if r.rank) == [1, 2, 3]


def test_drawn_rows_keep_their_columns(mixed, target):
    kept = importance.drawn_rows(mixed, target)
    assert kept.columns == mixed.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in plain_draw(mixed, target) if r[4]}


def plain_places(text):
    """The hashed runs of one to three characters, run by run."""
    out = set()
    codes = f" {' '.join(w.lower() for w in re.findall(r'[^\W\d_]+', text or ''))} "
    for i in range(len(codes)):
        state = 0
        for k in range(3):
            run = codes[i : i + k + 1]
            if len(run) <= k:
                break
            state = (state + ord(codes[i + k])) * int(language_id._FACTORS[k]) % 2**32
            state ^= state >> 15
            if run != " " and " " not in run[1:-1]:
                out.add((state * int(language_id._FACTORS[-1 - k]) % 2**32) >> 17)
    return out if codes.strip() else set()


TEXTS = ["The cat", "", None, "12 _ 3", "a", "Straße ÉTÉ 北京 x\U00010400y", "ab " * 50, "don't re-do it"]


@pytest.mark.parametrize("text", TEXTS)
def test_runs_of_a_text(text, monkeypatch):
    assert set(language_id.places(text).tolist()) == plain_places(text)
    monkeypatch.setattr(language_id, "PIECE", 4)
    whole = {p for w in re.findall(r"[^\W\d_]+", text or "") for p in plain_places(w)}
    assert whole <= set(language_id.places(text).tolist())


def test_kernel_is_the_cosine_of_presence():
    sets = [plain_places(t) for t in TEXTS if plain_places(t)]
    texts = [np.array(sorted(s), np.int32) for s in sets]
    model = language_id.Model(["x"], texts[:3])
    want = [[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets[:3]] for a in sets]
    assert np.allclose(model.rows(texts), want, atol=1e-6)


def test_ridge_with_all_rows_as_landmarks_is_kernel_ridge(monkeypatch):
    """With every row a landmark the approximation is exact: its values are those of the full kernel problem."""
    texts = [language_id.places(t) for t in ("the cat sat", "a cat and the dog", "der Hund und die Katze", "ein Hund")]
    lang = np.array([0, 0, 1, 1])
    model = language_id.Model(["en", "de"], texts)
    k = model.rows(texts)
    model.learn(k, lang)
    y, n, r = 2.0 * (lang[:, None] == np.arange(2)) - 1, 4, language_id.RIDGE * 4
    # stationary point of sum (K a + b - y)^2 + r a'K a
    solved = np.linalg.solve(np.block([[k + r * np.eye(n), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]]), np.vstack([y, np.zeros((1, 2))]))
    assert np.allclose(k @ model.dual + model.bias, k @ solved[:n] + solved[n:], atol=1e-4)


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs, "doc_id").filter("held_out").toPandas()
    assert len(got) > 150 and (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    wrong = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    again = language_id.identify(wrong).join(docs, "doc_id").filter("held_out").toPandas()
    assert got.sort_values("doc_id").lang_pred.tolist() == again.sort_values("doc_id").lang_pred.tolist()


def test_language_awkward(awkward, empty, docs_of):
    rows = language_id.identify(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    assert all(r.lang_pred in ("en", "de", "fr") and 0 <= r.score <= 1 for r in rows if r.doc_id > 3)
    assert language_id.identify(empty).count() == 0
    unlabelled = docs_of([(i, "some words", None, "s") for i in range(5)])
    assert {(r.lang_pred, r.score) for r in language_id.identify(unlabelled).collect()} == {("und", 0.0)}
