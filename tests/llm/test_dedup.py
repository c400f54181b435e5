import hashlib
import random
from collections import defaultdict

import pytest

from quarry.llm import minhash_dedup as M
from quarry.llm.components import components
from quarry.llm.exact_dedup import drop_copies, exact_dedup
from quarry.llm.minhash_dedup import block_links, minima, near_duplicates, shingle_set


def test_exact_groups(awkward):
    rows = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(awkward).collect()}
    assert {(1, 2, 2, False), (2, 2, 2, True), (4, 5, 2, False), (5, 5, 2, True), (6, 7, 3, False), (7, 7, 3, True)} <= rows
    one = exact_dedup(awkward).filter("doc_id = 4").first()
    assert one.text_sha256 == hashlib.sha256(b"one").hexdigest()
    assert exact_dedup(awkward).count() == awkward.count()


def test_exact_keeps_columns_and_empty(awkward, empty):
    kept = drop_copies(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [2, 3, 5, 7, 8, 9]
    assert exact_dedup(empty).count() == 0 and drop_copies(empty).count() == 0


def brute(rows, k, similar=80):
    """component of each id, by comparing all pairs of sets of shingles as text."""
    sets = {}
    for i, text in rows:
        w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if 100 * c >= similar * (len(sets[a]) + len(sets[b]) - c):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def edited(base, n, rng, vocabulary):
    words = base.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
    return " ".join(words)


def corpus(seed, groups=4, size=12, edits=9, words=120):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        base = " ".join(rng.choice(vocabulary) for _ in range(words))
        out += [base] + [edited(base, rng.randrange(edits), rng, vocabulary) for _ in range(size)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("stars,small", [(3, 8), (0, 1)])
def test_near_against_all_pairs(docs_of, monkeypatch, stars, small):
    """Also with no star round and with tiny blocks, so that block comparison does all the work."""
    monkeypatch.setattr(M, "STARS", stars)
    monkeypatch.setattr(M, "SMALL", small)
    monkeypatch.setattr(M, "BLOCK", 5)
    rows = corpus(3)
    comp, size = brute(rows, 4)
    got = near_duplicates(docs_of(rows), k=4).collect()
    assert {r.doc_id: r.component_id for r in got} == comp
    assert {r.doc_id: r.n_shingles for r in got} == size


def test_near_with_hot_classes(docs_of, monkeypatch):
    """A third of all rows is one text; its rows get their verdict by broadcast, others by a join, and as in brute force."""
    monkeypatch.setattr(M, "HOT", 6)
    rows = [t for _, t in corpus(9, groups=2, size=6)]
    rows = list(enumerate([*rows, *[rows[3]] * 12, *[rows[5]] * 2]))
    comp, size = brute(rows, 4)
    got = near_duplicates(docs_of(rows), k=4).collect()
    assert {r.doc_id: r.component_id for r in got} == comp and len(got) == len(rows)
    assert {r.doc_id: r.n_shingles for r in got} == size
    with pytest.raises(ValueError, match="80"):
        near_duplicates(docs_of(rows), similar=70)


def test_near_awkward(awkward, empty):
    got = {r.doc_id: r for r in near_duplicates(awkward, k=4).collect()}
    assert near_duplicates(awkward, k=4).count() == awkward.count()
    assert (got[1].n_shingles, got[1].component_id, got[1].kept) == (0, 1, True)
    assert (got[3].n_shingles, got[3].component_id) == (0, 3)
    assert (got[4].component_id, got[5].component_id, got[5].kept) == (4, 4, False)
    assert (got[6].component_id, got[7].component_id) == (6, 6)
    assert near_duplicates(empty, k=4).count() == 0


def test_block_links_join_what_pairs_join():
    rows = corpus(5, groups=1, size=25, edits=16)
    comp, _ = brute(rows, 4)
    sets = [shingle_set(t, 4) for _, t in rows]
    import numpy as np

    sigs = np.stack([(minima(s) * np.uint32(0x85EBCA6B) >> np.uint32(24)).astype(np.uint8) for s in sets])
    ids = [i for i, _ in rows]
    found = block_links(ids, ids, [0] * len(ids), [len(s) for s in sets], sigs, sets, False, 80)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    groups, want = defaultdict(set), defaultdict(set)
    for i in ids:
        groups[find(i)].add(i)
        want[comp[i]].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_hot_nodes(spark, monkeypatch):
    """Hot nodes get their least neighbour by broadcast, others by a join; both ways give the same."""
    from quarry.llm import components as module

    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(299, rng.randrange(300)) for _ in range(60)]
    links += [(i, i + 1) for i in range(1000, 1020)]
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for u, v in links if u != v for x in (u, v)}
    monkeypatch.setattr(module, "HOT", 4)
    got = {r.node: r.component for r in module.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == want
