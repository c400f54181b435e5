import math

import pytest
from pyspark.sql import functions as F

from quarry.llm import pii, quality_rules
from quarry.llm.license_scan import TEMPLATES, license_scan, scanned, template_join, vocabulary_of
from quarry.llm.quality_rules import binomial_tail, certified, measures
from quarry.llm.quality_rules import quality_rules as run_rules


def test_base_measures(docs_of):
    rows = {r.doc_id: r for r in measures(docs_of([(1, "a b c a b c x"), (2, "a a a a"), (3, "x # y\nx # y\n\n \nz"), (4, None)])).collect()}
    assert (rows[1].n_words, rows[1].n_repeat_words, rows[1].word_chars) == (7, 6, 7)
    assert (rows[2].n_repeat_words, rows[4].n_words) == (4, 0)
    assert (rows[3].n_symbols, rows[3].n_dup_lines, rows[3].n_lines) == (2, 1, 3)


def test_tail_is_exact(spark):
    rows = spark.createDataFrame([(k, n) for n in (1, 50, 4000) for k in (0, 1, 7, 30) if k <= n], "k long, n long")
    for r in rows.withColumn("p", binomial_tail(F.col("k"), F.col("n"), 0.02)).collect():
        want = sum(math.comb(r.n, j) * 0.02**j * 0.98 ** (r.n - j) for j in range(r.k + 1))
        assert r.p == pytest.approx(want if r.k <= r.n * 0.02 else 1.0, rel=1e-8)


def test_certified_only_with_enough_labels(docs_of, labels_of):
    good = " ".join(f"w{i}" for i in range(80))
    docs = docs_of([(i, f"{good} d{i}") for i in range(2600)] + [(9000 + i, f"{good} a ### b ### " * 1 + "# " * 60) for i in range(5)])
    few = certified(quality_rules.measures(docs), labels_of([(i, 1, 0) for i in range(100)])).count()
    many = certified(quality_rules.measures(docs), labels_of([(i, 1, 0) for i in range(2600)])).first()
    assert few == 0 and many.cut_symbols_per_word == 0.05
    kept = {r.doc_id: r.kept for r in run_rules(docs, labels_of([(i, 1, 0) for i in range(2600)])).collect()}
    assert all(kept[i] for i in range(2600)) and not any(kept[9000 + i] for i in range(5))


def test_rules_awkward(awkward, empty, labels_of):
    none = labels_of([])
    rows = run_rules(awkward, none)
    assert rows.count() == awkward.count() and run_rules(empty, none).count() == 0
    got = {r.doc_id: r for r in rows.collect()}
    assert got[1].base_failed and not got[1].kept and got[8].n_words == 30_000


def test_license_base_and_method(docs_of):
    docs = docs_of([
        (1, "Released under the MIT License. GNU General  Public-License mit license"),
        (2, "Licensed under CC BY-NC 4.0."),
        (3, "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met"),
        (4, "the license of the mit"), (5, None), (6, "mit license " * 3),
    ])
    r = {x.doc_id: x for x in license_scan(docs).collect()}
    assert (r[1].n_words, r[1].n_base, r[1].first_word, r[1].last_word, r[1].base_labels) == (11, 3, 3, 9, "gpl,mit")
    assert r[2].base_labels == "cc-by" and "cc-by-nc" in r[2].labels.split(",")
    assert (r[3].base_labels, r[3].labels) == ("", "bsd") and r[3].score == 1.0
    assert (r[4].labels, r[4].score, r[5].n_words, r[5].first_word) == ("", 0.0, 0, None)
    assert (r[6].n_base, r[6].last_word) == (3, 4)


def test_similarity_join_finds_every_pair(docs_of):
    import random

    rng = random.Random(4)
    words = [*vocabulary_of(), "x", "y"]
    rows = [(i, "\n\n".join("\n".join(" ".join(rng.sample(words, rng.randrange(4, 30))) for _ in range(3)) for _ in range(3))) for i in range(150)]
    rows += [(1000 + i, " ".join(w for w in t.split() if rng.random() < 0.85)) for i, (_, t, _, _) in enumerate(TEMPLATES)]
    got = {(r.doc_id, r.label, round(r.containment, 9)) for r in template_join(scanned(docs_of(rows), vocabulary_of()), TEMPLATES, 0.6).collect()}
    want = set()
    for i, text in rows:
        for label, t, needs, bars in TEMPLATES:
            s = set(t.split())
            for b in text.split("\n\n"):
                have = set(b.split())
                c = len(s & have)
                if c >= math.ceil(0.6 * len(s) - 1e-9) and have >= set(needs.split()) and not have & set(bars.split()):
                    want.add((i, label, round(c / len(s), 9)))
    assert len(want) > 100
    assert got == want


def test_license_awkward(awkward, empty):
    rows = license_scan(awkward)
    assert rows.count() == awkward.count() and license_scan(empty).count() == 0
    r = rows.filter("doc_id = 9").first()
    # the Kelvin sign and the dotted capital I stay what they are
    assert (r.n_words, r.base_labels) == (8, "mit")


def test_pii_spans_and_terms(docs_of):
    filler = "the weather was fine and nobody had seen anything like it before"
    rows = [(i, f"{filler} {i}. contact passcode user{i}@mail.example.org now, {filler}") for i in range(40)]
    rows += [(100, f"{filler} passcode"), (101, "+1 (974) 555-3436, 10.0.0.1 256.1.1.1; 4111 1111 1111 1111 a@b a.b@c.d.e"), (102, None), (103, 'key = "abcdefghij0123456789XYZ"')]
    docs = docs_of(rows)
    terms = {r.term for r in pii.disclosing_terms(docs).collect()}
    assert "passcode" in terms and "weather" not in terms and "nobody" not in terms
    r = {x.doc_id: x for x in pii.find_pii(docs, clean_text=True).collect()}
    assert r[100].spans.startswith("term:") and "passcode" not in r[100].clean_text
    assert (r[101].n_phone, r[101].n_ip, r[101].n_card, r[101].n_email) == (1, 1, 1, 1)
    assert r[101].spans.split(",")[0] == "phone:0:17" and "[CARD]" in r[101].clean_text
    assert (r[102].spans, r[102].n_email) == ("", 0) and r[103].spans == "secret:7:30"


def naive_disclosure(rows, window):
    """Terms beside entities and in all, counted plainly: term -> (different entities, occurrences beside, in all)."""
    import re
    from collections import Counter, defaultdict

    entities, near, total = defaultdict(set), Counter(), Counter()
    for _, text in rows:
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{3,}", text or "")]
        total.update(w for _, _, w in words)
        for kind, a, b in pii.base_spans(text or "") + pii.secret_spans(text or ""):
            left = [w for _, e, w in words if e <= a][-window:]
            right = [w for s, _, w in words if s >= b][:window]
            for w in left + right:
                entities[w, kind].add(text[a:b])
                near[w, kind] += 1
    return {k: (len(v), near[k], total[k[0]]) for k, v in entities.items()}


def test_disclosing_terms_of_the_small_tables(spark):
    """What the operator finds at 0.01 is what a naive count of whole texts says, and it finds something."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    naive = naive_disclosure(rows, pii.WINDOW)
    words = sum(len(pii._TERM.findall(t or "")) for _, t in rows)
    want = set()
    for (term, kind), (entities, near, total) in naive.items():
        q = sum(n for (_, k), (_, n, _) in naive.items() if k == kind) / words
        p = near / total
        bits = p * math.log2(p / q) + ((1 - p) * math.log2((1 - p) / (1 - q)) if p < 1 else 0)
        if p > q and bits / -math.log2(q) >= pii.REVEAL and entities * bits >= math.log2(words / pii.DELTA):
            want.add((term, kind, entities, near, total))
    got = {(r.term, r.kind, r.entities, r.near, r.total) for r in pii.disclosing_terms(docs).collect()}
    assert got == want and ("token", "secret") in {x[:2] for x in got}


def test_pii_joined_terms_give_the_same(docs_of, monkeypatch):
    """With more terms than are sent to the tasks, those of each row come by a join."""
    rows = [(i, f"it was fine {i}. contact passcode user{i}@mail.example.org now, and so on it went") for i in range(40)]
    docs = docs_of([*rows, (0, "passcode"), (0, "passcode"), (77, None), (78, "")])
    want = sorted(map(tuple, pii.find_pii(docs, clean_text=True).collect()))
    monkeypatch.setattr(pii, "SENT", 0)
    assert sorted(map(tuple, pii.find_pii(docs, clean_text=True).collect())) == want
    assert sum("term:" in r[-2] for r in want) == 42


def test_base_spans_are_those_of_the_patterns():
    """Against the contract's patterns as they stand, on random texts of the letters that matter."""
    import random
    import re

    def brute(text):
        out = []
        for kind, pattern in (
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
        ):
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                good = {
                    "email": lambda: True,
                    "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                    "card": lambda: 12 <= len(digits) <= 19 and sum(map(int, "".join(str(int(d) * (1 + i % 2)) for i, d in enumerate(reversed(digits))))) % 10 == 0,
                    "phone": lambda: 9 <= len(digits) <= 15,
                }[kind]()
                if good:
                    out.append((kind, m.start(), m.end()))
        return sorted(out, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0])))

    rng = random.Random(8)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789.. -+@ab()é\n") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == brute(text)


def test_pii_linear_on_long_runs():
    import time

    t = time.time()
    for text in ("1" * 200_000, "a" * 200_000, "@" * 100_000, "+1" + "(" * 200_000, "1." * 100_000, "a@" + "b" * 200_000):
        pii.base_spans(text)
    assert time.time() - t < 10


def test_pii_awkward(awkward, empty):
    got = sorted((r.doc_id, r.spans, r.private, r.n_secret, r.n_term) for r in pii.find_pii(awkward).collect())
    assert got == sorted((r.doc_id, "", False, 0, 0) for r in awkward.collect())
    assert pii.find_pii(awkward).count() == awkward.count() and pii.find_pii(empty).count() == 0


def test_license_wrapped_notices(docs_of):
    """Every notice, broken after every word and after each, between lines of prose, has its own label only."""
    cuts = [(label, [w[:k], w[k:]]) for label, t, _, _ in TEMPLATES for w in [t.split()] for k in range(1, len(w))]
    cuts += [(label, [[w] for w in t.split()]) for label, t, _, _ in TEMPLATES]
    docs = docs_of([(i, "a b\n" + ",\n# ".join(map(" ".join, parts)) + ".\nc d") for i, (_, parts) in enumerate(cuts)])
    got = {r.doc_id: r for r in license_scan(docs).collect()}
    def labels(label):
        return f"cc-by,{label}" if label.startswith("cc-by-") else label  # the base phrase is in them

    assert [(label, got[i].labels) for i, (label, _) in enumerate(cuts) if (got[i].labels, got[i].score) != (labels(label), 1.0)] == []
    german = docs_of([(1, "Licensed under the Apache License, mit Worten")])
    assert license_scan(german).first().labels == "apache"
    apart = docs_of([(1, "licensed under the gnu lesser\n\ngeneral public license"), (2, "Creative Commons Attribution-NonCommercial 4.0 International License, licensed under a")])
    assert {r.labels for r in license_scan(apart).collect()} == {""}
