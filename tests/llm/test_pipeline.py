"""Each stage of the pipeline against a plain version of it, on the rows that its predecessor left."""

from collections import Counter

import corpus_pipeline as P
from quarry.llm import quality_classifier
from quarry.llm.piece_nbest import Segmenter, load
from quarry.llm.source_mix import mix
from tests.llm.test_dedup import brute, corpus


def test_stages(spark, docs_of, labels_of, tmp_path):
    good = [t for _, t in corpus(11, groups=5, size=6, edits=7, words=70)]
    bad = [f"BUY!! {i} ### NOW!! $$$ ***" * 5 for i in range(12)]
    rows = [(i, t, "en", f"s{i % 4}") for i, t in enumerate([*good, *good[:9], *bad])]
    docs = docs_of(rows)
    folder = str(tmp_path)
    labels_of([(i, int(i < len(good) + 9), 0) for i in range(0, len(rows), 2)]).write.parquet(f"{folder}/labels.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")

    now = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in P.STAGES:
        now = stage(spark, now, folder)
        now.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        kept.append(now.collect())
    assert all(set(k[0].asDict()) == set(docs.columns) for k in kept[:4])
    texts = {r[0]: r[1] for r in rows}

    ids = [sorted(r.doc_id for r in k) for k in kept]
    n_good = len(good) + 9
    assert ids[0] == list(range(n_good))
    last = {texts[i]: i for i in ids[0]}
    assert ids[1] == sorted(last.values())
    comp, _ = brute([(i, texts[i]) for i in ids[1]], 5)
    assert ids[2] == sorted(i for i in ids[1] if comp[i] == i)
    near = docs.filter(docs.doc_id.isin(ids[2]))
    times = {r.doc_id: r.passes for r in mix(near).collect()}
    assert Counter(ids[3]) == Counter({i: n for i, n in times.items() if n})
    seg = Segmenter(*load())
    assert ids[4] == ids[3]
    for r in kept[4]:
        want, ways, _ = seg.encode(texts[r.doc_id])
        assert (r.n_pieces, r.score) == (len(want), ways[0][0]) and r.round_trip

    assert sorted(r.doc_id for r in P.run(spark, folder).collect()) == ids[4]


def test_first_stage_keeps_what_no_label_speaks_against(spark, docs_of, labels_of):
    docs = docs_of([(1, "a"), (2, None)])
    assert quality_classifier.keep_good(docs, labels_of([])).count() == 2
