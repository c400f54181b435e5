import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import quality_classifier, source_mix, toxicity
from quarry.llm.html_extract import best_run, extract_pages, main_text
from quarry.llm.piece_nbest import Segmenter, decode_documents, encode_documents, load
from quarry.llm.source_mix import min_cost_flow, mix, mixed_rows, plan, targets


@pytest.fixture(scope="module")
def toxic_case(docs_of, labels_of):
    rng = np.random.default_rng(0)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = rng.choice(words, 40).tolist()
        bad = i % 9 == 0
        if bad:
            text[5] = text[20] = ["vileone", "viletwo", "vilethree"][i % 3]
        rows.append((i, " ".join(text)))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    return docs_of(rows), labels_of(labels)


def test_toxicity_held_out(toxic_case):
    docs, labels = toxic_case
    rows = toxicity.toxicity(docs, labels).toPandas().set_index("doc_id")
    held = rows[rows.held_out]
    truth = held.index.to_numpy() % 9 == 0
    assert 0.15 < len(held) / len(rows) < 0.35
    assert ((held.predicted == 1) == truth).mean() > 0.97
    assert (rows.score.between(0, 1)).all()


def test_toxicity_never_learns_from_held_out_rows(toxic_case):
    docs, labels = toxic_case
    wrong = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, wrong)


def test_nnpu_risk_stays_sane():
    x = np.zeros((60, 3), np.uint8)
    x[:10, 0] = 1
    x[10:14, 0] = 1
    x[30:, 1] = 1
    w, b = toxicity.train_nnpu(x, np.arange(60) < 10, 0.08)
    assert w[0] > 0.5 and w[1] == 0 and b < 0


def test_toxicity_awkward(awkward, empty, labels_of):
    none = labels_of([])
    assert toxicity.toxicity(awkward, none).filter("predicted = 0").count() == awkward.count()
    assert toxicity.toxicity(empty, none).count() == 0
    assert toxicity.toxicity(awkward, labels_of([(4, 1, 1), (8, 1, 0), (4, 0, None)])).count() == awkward.count()


def test_quality_shrinks_and_separates(docs_of, labels_of):
    good = "The house on the hill was old, and {} nobody had lived in it for a long time. It stood empty."
    bad = "BUY!! NOW!! {} ### $$$ BUY!! NOW!! ### *** BUY!!"
    rows = [(i, (bad if i % 3 == 0 else good).format(i), "en", f"s{i % 5}") for i in range(300)]
    labels = labels_of([(i, int(i % 3 != 0), 0) for i in range(0, 300, 2)])
    r = quality_classifier.quality(docs_of(rows), labels).toPandas().set_index("doc_id")
    assert (r.kept == (r.index % 3 != 0)).all()
    kept = quality_classifier.keep_good(docs_of(rows), labels)
    assert kept.columns == docs_of(rows).columns and kept.count() == 200


def test_quality_prior_follows_the_site(docs_of, labels_of):
    groups = docs_of([(0, "x")]).sparkSession.createDataFrame([(100, 95.0, 91.0), (100, 10.0, 6.0), (100, 50.0, 40.0)], "n long, s double, q double")
    same = groups.select("n", F.lit(50.0).alias("s"), F.lit(40.0).alias("q"))
    assert quality_classifier._strength(groups) < 5 < quality_classifier._strength(same)


def test_quality_awkward(awkward, empty, labels_of):
    none = labels_of([])
    assert quality_classifier.quality(awkward, none).filter("kept").count() == awkward.count()
    assert quality_classifier.quality(empty, none).count() == 0
    some = labels_of([(4, 1, 0), (8, 0, 0), (6, 1, 0), (7, None, None)])
    assert quality_classifier.quality(awkward, some).count() == awkward.count()


def test_targets_and_flow():
    t = targets({"a": 100, "b": 10, None: 40})
    assert t["b"] == 30.0 and sum(t.values()) == pytest.approx(150) and t[None] == 90.0
    arcs = [(0, 1, 5, 1), (0, 2, 5, 4), (1, 3, 4, 0), (2, 3, 9, 0), (1, 2, 9, 1)]
    assert min_cost_flow(arcs, 4, 0, 3) == [5, 5, 4, 6, 1]
    # of an overlapping pattern, repetition is the last resort
    given = plan({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 25, "b": 5})
    assert given[("a",)]["a"] + given[("a", "b")]["a"] == 25 and sum(given[("b",)].values()) + given[("a", "b")]["b"] == 5


def test_mix_meets_targets(docs_of):
    rows = [(i, "w " * (1 + i % 37), "en", ["s1", "s2", None, "s3"][min(i % 7, 3)]) for i in range(700)]
    r = mix(docs_of(rows)).join(docs_of(rows).select("doc_id", "source"), "doc_id").toPandas()
    assert (r.taken <= 3 * r["size"]).all() and (r.taken >= 0).all()
    sums = r.fillna({"source": "-"}).groupby("source").agg(k=("taken", "sum"), t=("target", "first"))
    assert ((sums.k - sums.t).abs() <= 1).all()
    assert mix(docs_of(rows)).exceptAll(mix(docs_of(rows))).count() == 0


def test_mix_awkward(awkward, empty):
    assert mix(awkward).count() == awkward.count() and mix(empty).count() == 0
    assert mixed_rows(awkward).columns == awkward.columns and mixed_rows(empty).count() == 0


def paths(seg, chunk):
    """All segmentations in the documented order, each as (score, ids)."""

    def up_to(j):
        if j == 0:
            return [(0.0, (), ())]
        out = []
        for i, p, _, s in seg.edges(chunk, j):
            ids = (p,) if p >= 0 else tuple(seg.by_byte[b] for b in chunk[i].encode())
            out += [(a + s, q + ids, (i, *starts)) for a, q, starts in up_to(i)]
        return out

    # ties: fewer pieces, then from the end the longer piece, that is the smaller start
    return [(a, list(p)) for a, p, _ in sorted(up_to(len(chunk)), key=lambda x: (-x[0], len(x[1]), x[2]))]


def test_nbest_is_that_of_all_paths():
    """Random texts of few letters, so that ties and repeated chunks abound; all of the N best, in order, with ids."""
    rng, seg = np.random.default_rng(5), Segmenter(*load())
    texts = ["there", "of ingthe", "nan an nan", "éa 日", "aaaa", "aaaaaaaa", "", *("".join(rng.choice([*"ab aan =日e"], rng.integers(1, 11))) for _ in range(150))]
    for text in texts:
        n = int(rng.integers(1, 7))
        got = seg.nbest(text, n)
        assert all(seg.decode(ids) == text for _, ids in got)
        assert got == (paths(seg, " " + text)[:n] if text else [(0.0, [])])
        assert seg.encode(text, n)[0].tolist() == got[0][1]


_LONG_RUN = """
import resource, sys, time
from quarry.llm.piece_nbest import Segmenter, load
text = {"letters": "abcdefghij" * 100_000, "base64": "".join(chr(48 + i * i * 7919 % 75) for i in range(1_000_000))}[sys.argv[1]]
seg = Segmenter(*load())
begun = time.process_time()
ids, ways, same = seg.encode(text, 4)
assert same and len(ways) == 4 and seg.decode(ids.tolist()) == text
assert [w[0] for w in ways] == sorted((w[0] for w in ways), reverse=True) and len({w[1].tobytes() for w in ways}) == 4
print(time.process_time() - begun, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)
"""


@pytest.mark.parametrize("kind", ["letters", "base64"])
def test_nbest_of_a_million_characters_without_a_space(kind):
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", _LONG_RUN, kind], capture_output=True, text=True, check=True, timeout=120)
    seconds, megabytes = map(float, done.stdout.split())
    assert seconds < 15 and megabytes < 500


def test_piece_round_trip(awkward, empty):
    rows = encode_documents(awkward)
    assert rows.filter("not round_trip").count() == 0 and encode_documents(empty).count() == 0
    back = {r.doc_id: r.text for r in decode_documents(rows).collect()}
    assert back[9] == awkward.filter("doc_id = 9").first().text and back[1] == ""
    r = rows.filter("doc_id = 8").first()
    assert r.nbest_scores == sorted(r.nbest_scores, reverse=True) and r.nbest_scores[0] == r.score
    assert r.nbest_ids[0] == r.ids and [len(x) // 2 for x in r.nbest_ids] == r.nbest_pieces
    assert len({bytes(x) for x in r.nbest_ids}) == 4
    one = rows.filter("doc_id = 1").first()
    assert (one.n_pieces, one.nbest_scores, one.nbest_pieces, one.nbest_ids) == (0, [0.0], [0], [b""])


PAGES = [
    ("<article><h1>A</h1><form><label>mail</label></form><p>B c d</p><div class=advert>Ad words</div><p>E &amp; f&nbsp;g</p></article><footer>x y</footer>", "A B c d E & f g"),
    ("<nav><a href=1>x</a></nav><div id='sidebar'><p>about me</p></div><div class='post-content'><p>Real <b>te</b>xt is here.</p><section class='comments'><p>I agree</p></section></div>", "Real text is here."),
    ("<script>var a='</p>';</script><style>p{}</style><p>only this</p>", "only this"),
    ("", ""), (None, ""), ("<form>a b</form>", ""), ("x < y", "x < y"),
    ("<body><nav><ul><li>menu<article><p>Body of it</p></article>", "Body of it"),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_main_text(html, text):
    assert main_text(html) == text


def test_best_run_is_maximal():
    rng = np.random.default_rng(2)
    for _ in range(50):
        s = rng.normal(size=12).tolist()
        a, b = best_run(s)
        assert sum(s[a:b]) == pytest.approx(max([0.0, *(sum(s[i:j]) for i in range(12) for j in range(i + 1, 13))]))


def test_pages_table(spark):
    df = spark.createDataFrame([(i, f"u{i}", h, 1, "z") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, n_chars int, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_pages(df).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)}
    assert extract_pages(df.limit(0)).count() == 0
    again = extract_pages(df.unionByName(df)).groupBy("page_id", "text").count().collect()
    assert all(r["count"] == 2 for r in again) and len(again) == len(PAGES)
