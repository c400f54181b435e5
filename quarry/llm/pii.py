"""Personal data: pattern spans, and terms that give protected entities away.

Protected entities are what the patterns find (email, ip, card, phone) and quoted credentials (secret). For each term and kind
the corpus says how much an occurrence of the term discloses about an entity beside it, within ``WINDOW`` terms: with p the
share of its occurrences beside an entity and q that of any word, the specific information is
``D = p log2(p / q) + (1 - p) log2((1 - p) / (1 - q))`` bits. Its share of the most that can be known, ``log2(1 / q)``, is the
term's disclosure, so the thresholds hold whatever the corpus' size and the entities' frequency: from ``REVEAL`` on a term is
generalised to the kind, from ``REMOVE`` on it is removed. Chance is kept out by the evidence: D times the number of different
entities (copies of one text don't count) must exceed ``log2(words / DELTA)``, which grows with the corpus as the number
of terms that are tried does.

Pass 1 counts terms beside entities (few rows) and words. Pass 2 counts all occurrences of the terms with enough entities: their
set is sent to the tasks while it has at most ``SENT`` terms, and is joined beyond. Pass 3 writes the spans, with the
disclosing terms sent or joined likewise.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import stored

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "term")
WINDOW = 3
#: Disclosure from which a term is generalised, that from which it is removed, and the chance of a term by accident.
REVEAL, REMOVE, DELTA = 0.4, 0.8, 0.01
#: Terms that are sent to every task, at most (about 10 MB); more are joined.
SENT = 100_000

_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"""(?<![A-Za-z])[A-Za-z][A-Za-z0-9_.-]{0,40}\s?[=:]\s?(["'])([A-Za-z0-9+/_=-]{20,})\1""")
_DIGITS = re.compile(r"[^0-9]+")
_TERM = re.compile(r"[^\W\d_]{3,}")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, searched from each "@" so that long words cost nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed; code points, end exclusive."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    """Quoted values of at least 20 characters after a name and "=" or ":"."""
    if '"' not in text and "'" not in text:
        return []
    return [("secret", m.start(2), m.end(2)) for m in _SECRET.finditer(text)]


def beside(text: str, spans: list[tuple[str, int, int]], window: int = WINDOW) -> Iterator[tuple[str, str, str]]:
    """(term, kind, entity) for the ``window`` terms of the text on each side of a span, those within it left out."""
    if not spans:
        return
    terms = [(m.start(), m.end()) for m in _TERM.finditer(text)]
    starts, ends = [a for a, _ in terms], [b for _, b in terms]
    for kind, start, end in spans:
        left, right = bisect_right(ends, start), bisect_left(starts, end)
        for a, b in terms[max(0, left - window) : left] + terms[right : right + window]:
            yield text[a:b].lower(), kind, text[start:end]


def _context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms beside entities, with a digest of the entity; and all terms of the batch under the term ""."""
    for batch in batches:
        seen: Counter = Counter()
        for text in (v.as_py() for v in batch.column("text")):
            if text:
                seen["", "", b""] += sum(1 for _ in _TERM.finditer(text))
                for term, kind, entity in beside(text, base_spans(text) + secret_spans(text)):
                    seen[term, kind, hashlib.blake2b(entity.encode(), digest_size=8).digest()] += 1
        rows = [(t, k, e, n) for (t, k, e), n in seen.items()]
        cols = [*zip(*rows, strict=True)] or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.binary(), pa.int64()), strict=True)],
            ["term", "kind", "entity", "n"],
        )


def _totals(terms: frozenset[str] | None):
    """Occurrences of ``terms`` (None: of all terms) in a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for value in batch.column("text"):
                text = value.as_py()
                found = _TERM.findall(text.lower()) if text else []
                seen.update(found if terms is None else filter(terms.__contains__, found))
            yield pa.RecordBatch.from_arrays(
                [pa.array([*seen], pa.string()), pa.array([*seen.values()], pa.int64())], ["term", "n"]
            )

    return run


def disclosing_terms(docs: DataFrame, reveal: float = REVEAL, delta: float = DELTA) -> DataFrame:
    """``term, kind, entities, near, total, bits, disclosure`` of the terms that disclose an entity of that kind.

    Defined cases: without texts or entities there are none; null texts count as empty; of a term that stands beside
    entities of several kinds each is judged by itself.
    """
    texts = docs.select("text")
    near = texts.mapInArrow(_context, "term string, kind string, entity binary, n long")
    near = near.groupBy("term", "kind", "entity").agg(F.sum("n").alias("n"))
    near = near.groupBy("term", "kind").agg(F.count(F.lit(1)).alias("entities"), F.sum("n").alias("near"))
    near = stored(near, "pii-context")
    # a row for each kind
    kinds = {r.kind: r.n for r in near.groupBy("kind").agg(F.sum("near").alias("n")).collect()}
    words = max(1, kinds.pop("", 0))
    rates = {k: min(0.5, n / words) for k, n in kinds.items()}
    least = log2(words / delta)
    rate = F.create_map(*[F.lit(x) for k, q in rates.items() for x in (k, q)]) if rates else F.create_map(F.lit(""), F.lit(0.5))
    known = near.filter("term <> ''").withColumn("q", F.element_at(rate, F.col("kind")))
    # no term discloses more than log2(1 / q) bits
    wanted = known.filter(F.col("entities") * -F.log2("q") >= least)
    terms = wanted.select("term").distinct()
    n_terms = terms.count()
    if n_terms <= SENT:
        sent = frozenset(r.term for r in terms.collect())
        totals = texts.mapInArrow(_totals(sent), "term string, n long").groupBy("term").agg(F.sum("n").alias("total"))
    else:
        everything = texts.mapInArrow(_totals(None), "term string, n long")
        totals = everything.groupBy("term").agg(F.sum("n").alias("total")).join(terms, "term", "left_semi")
    joined = wanted.join(totals, "term").withColumn("p", F.least(F.lit(1.0), F.col("near") / F.col("total")))
    p, q = F.col("p"), F.col("q")
    bits = p * F.log2(p / q) + F.when(p < 1, (1 - p) * F.log2((1 - p) / (1 - q))).otherwise(F.lit(0.0))
    joined = joined.withColumn("bits", bits).withColumn("disclosure", F.col("bits") / -F.log2("q"))
    found = joined.filter((p > q) & (F.col("disclosure") >= reveal) & (F.col("entities") * F.col("bits") >= least))
    return stored(found.select("term", "kind", "entities", "near", "total", "bits", "disclosure"), "pii-terms")


Levels = dict[str, tuple[str, float]]


def _spans(sent: Levels):
    """Spans, counts and sanitised text; terms' levels are those of ``sent``, or of the row's own ``levels``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            shas, joined, cleaned = [], [], []
            own = batch.column("levels") if "levels" in batch.schema.names else None
            for i, value in enumerate(batch.column("text")):
                text = value.as_py() or ""
                levels = sent if own is None else {x["term"]: (x["kind"], x["disclosure"]) for x in own[i].as_py() or ()}
                base = base_spans(text)
                more = secret_spans(text)
                if levels:
                    more += [("term", m.start(), m.end()) for m in _TERM.finditer(text) if m[0].lower() in levels]
                spans = sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in spans))
                shas.append(hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest())
                joined.append(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
                cleaned.append(sanitised(text, spans, levels) if spans else text)
            private = [any(n) for n in zip(*(counts[k] for k in KINDS if k != "term"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *[pa.array(counts[k], pa.int64()) for k in KINDS],
                    pa.array(private, pa.bool_()),
                    pa.array(shas, pa.string()),
                    pa.array(joined, pa.string()),
                    pa.array(cleaned, pa.string()),
                ],
                ["doc_id", *[f"n_{k}" for k in KINDS], "private", "base_sha256", "spans", "clean_text"],
            )

    return run


def sanitised(text: str, spans: list[tuple[str, int, int]], levels: Levels) -> str:
    """The text with entities as ``[KIND]``, terms generalised to ``[KIND-CONTEXT]`` or removed; overlaps go with
    the span that starts first."""
    out, end = [], 0
    for kind, a, b in spans:
        if a < end:
            end = max(end, b)
            continue
        out.append(text[end:a])
        if kind != "term":
            out.append(f"[{kind.upper()}]")
        else:
            of, disclosure = levels[text[a:b].lower()]
            out.append("" if disclosure >= REMOVE else f"[{of.upper()}-CONTEXT]")
        end = b
    return "".join([*out, text[end:]])


def _row_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, term) for the different terms of each row's text."""
    for batch in batches:
        for row, value in zip(batch.column("row"), batch.column("text"), strict=True):
            terms = sorted({t.lower() for t in _TERM.findall(value.as_py() or "")})
            yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(terms), pa.int64()), pa.array(terms, pa.string())], ["row", "term"])


def _with_levels(docs: DataFrame, levels: DataFrame) -> DataFrame:
    """``doc_id, text, levels``: each row with the disclosing terms that its own text has, by a join on the term."""
    rows = stored(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "pii-rows")
    met = rows.select("row", "text").mapInArrow(_row_terms, "row long, term string").join(levels, "term")
    met = met.groupBy("row").agg(F.collect_list(F.struct("term", "kind", "disclosure")).alias("levels"))
    return rows.join(met, "row", "left").select("doc_id", "text", "levels")


def find_pii(docs: DataFrame, clean_text: bool = False) -> DataFrame:
    """Per document: counts of each kind, ``private`` (an entity was found), the digest of the base spans, all spans; and
    the sanitised text.

    Defined cases: a null or empty text has no spans; the digest of no spans is that of the empty string; very long texts are
    searched whole, in time linear in their length; rows repeated with one id are searched each; equal entities in many
    copies count once towards a term's evidence; a term that discloses several kinds has that of the greatest disclosure, of
    equals the first by name; an empty table gives an empty result; other columns are ignored.
    """
    found = disclosing_terms(docs)
    best = F.max(F.struct(F.col("disclosure"), -F.ascii("kind"), F.col("kind"))).alias("x")
    levels = found.groupBy("term").agg(best).select("term", "x.kind", "x.disclosure")
    sent: Levels = {}
    rows = docs.select("doc_id", "text")
    if levels.count() <= SENT:
        sent = {r.term: (r.kind, r.disclosure) for r in levels.collect()}
    else:
        rows = _with_levels(docs, levels)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    rows = rows.mapInArrow(
        _spans(sent), f"doc_id {id_type}, {counts}, private boolean, base_sha256 string, spans string, clean_text string"
    )
    return rows if clean_text else rows.drop("clean_text")
