"""Quality rules whose cutoffs come with a guarantee on false rejections.

Each rule rejects a document when a measure exceeds a cutoff out of a grid that is fixed beforehand. On the
labelled documents of good quality (the holdout: nothing is fitted on them) the rule's false rejections
are counted for each stratum and cutoff. A cutoff is *certified* when the exact binomial test rejects
"the false-rejection rate is above ``alpha / rules``" at level ``delta / tests`` (Bonferroni over all strata,
rules and cutoffs). The sharpest certified cutoff is applied; without one, the rule is off in that stratum. With
probability ``1 - delta`` no stratum then loses more than ``alpha`` of its good documents to the rules.

Everything runs as DataFrame expressions: one pass over the text makes a narrow table of measures, the rest
reads that table.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import SPACE, stored

#: Rule: (measure, cutoffs from sharp to lax).
RULES: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (0.05, 0.1, 0.2, 0.35, 0.5, 0.8, 1.2),
    "dup_line_share": (0.1, 0.2, 0.3, 0.45, 0.6),
    "repeat_word_share": (0.1, 0.15, 0.2, 0.3, 0.4),
    "chars_per_word": (7.0, 8.0, 9.0, 10.0, 12.0, 16.0),
}
#: Most of a stratum's good documents that the rules may reject, and the chance that this is broken.
ALPHA, DELTA = 0.02, 0.05
SYMBOLS = "#*$%&|<>"


def measures(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and the base measures of every whole text, by built-in functions alone."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), text.alias("t"))
    rows = rows.select(
        "doc_id",
        "stratum",
        F.filter(F.split("t", SPACE), lambda w: w != "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
    )
    rows = rows.select(
        "doc_id",
        "stratum",
        "w",
        "n_symbols",
        F.size("w").alias("n"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    tri = F.when(
        F.col("n") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.col("n") - 3),
            lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)),
        ),
    )
    rows = rows.select(*[c for c in rows.columns if c != "w"], tri.alias("tri"))
    # only texts with a window found twice go on to the sort
    ranked = F.when(
        F.size("tri") > F.size(F.array_distinct("tri")),
        F.sort_array(F.transform("tri", lambda t, i: F.struct(t.alias("t"), i.alias("i")))),
    )
    rows = rows.select(*[c for c in rows.columns if c != "tri"], ranked.alias("s"))
    twice = F.filter(
        "s",
        lambda x, k: F.coalesce(F.get("s", k - 1)["t"] == x["t"], F.lit(False))
        | F.coalesce(F.get("s", k + 1)["t"] == x["t"], F.lit(False)),
    )
    rows = rows.select(*[c for c in rows.columns if c != "s"], F.transform(twice, lambda x: x["i"]).alias("at"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda i: F.array(i, i + 1, i + 2)))))
    return rows.select(
        "doc_id",
        "stratum",
        F.col("n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_lines",
        "n_dup_lines",
        F.when(F.col("at").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
    )


def with_shares(rows: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return rows.withColumns(
        {
            "symbols_per_word": F.col("n_symbols") / words,
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
            "repeat_word_share": F.col("n_repeat_words") / words,
            "chars_per_word": F.col("word_chars") / words,
        }
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x), x >= 1, by Stirling's series at x + 8."""
    z = x + 8.0
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    shift = sum((F.log(x + float(i)) for i in range(1, 8)), F.log(x))
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial(n, p): the terms from k downwards until they no longer count.

    Above the mean the tail is over 0.3 and certifies nothing, so 1 is returned without a sum.
    """
    kd, nd = k.cast("double"), n.cast("double")
    ratio = (1 - p) / p
    first = F.exp(
        _log_gamma(nd + 1)
        - _log_gamma(kd + 1)
        - _log_gamma(nd - kd + 1)
        + kd * log(p)
        + (nd - kd) * log(1 - p)
    )
    steps = F.least(k, F.ceil(12 * F.sqrt(nd * p) + 64)).cast("long")
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), steps),
        F.struct(F.lit(0.0).alias("sum"), first.alias("term")),
        lambda s, j: F.struct(
            (s["sum"] + s["term"]).alias("sum"),
            (s["term"] * (kd - j) / (nd - kd + j + 1) * ratio).alias("term"),
        ),
        lambda s: s["sum"],
    )
    return F.when(kd > nd * p, F.lit(1.0)).otherwise(F.least(total, F.lit(1.0)))


def certified(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with a certified cutoff: for each rule the sharpest one, or null.

    ``labels`` has ``doc_id, quality``; a document counts once however often it is labelled, and null labels
    do not count. The result has as many rows as there are strata.
    """
    good = labels.filter("quality = 1").select("doc_id").distinct()
    held = with_shares(rows).join(good, "doc_id", "left_semi").filter(~base_failed())
    tests = [(r, c) for r, cutoffs in RULES.items() for c in cutoffs]
    counts = held.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(r) > c).alias(f"k{i}") for i, (r, c) in enumerate(tests)]
    )
    counts = stored(counts, "rule-counts")
    strata = max(1, counts.count())
    level = delta / (strata * len(tests))
    long = counts.select(
        "stratum",
        "n",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k{i}").alias("k"))
                    for i, (r, c) in enumerate(tests)
                ]
            )
        ),
    )
    passed = long.filter(binomial_tail(F.col("k"), F.col("n"), alpha / len(RULES)) <= level)
    return passed.groupBy("stratum").agg(
        *[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES]
    )


def quality_rules(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA
) -> DataFrame:
    """Verdicts per document: the base measures, ``base_failed``, ``kept`` and the rules that rejected it.

    Defined cases: a null or empty text has no words, fails the base rule and is not kept; a null stratum is
    a stratum of its own, ""; without labels no cutoff is certified and the base rule alone decides; rows
    repeated with one id are judged each; an empty table gives an empty result; other columns are ignored.
    """
    rows = stored(measures(docs, stratum), "rule-measures")
    cuts = certified(rows, labels, alpha, delta)
    judged = with_shares(rows).join(cuts, "stratum", "left").withColumn("base_failed", base_failed())
    over = F.array_compact(
        F.array(*[F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES])
    )
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.size(over) == 0)).alias("kept"),
        F.array_join(over, ",").alias("rejected_by"),
    )


def _sql() -> str:
    tests = [(r, c) for r, cutoffs in RULES.items() for c in cutoffs]
    grid = ", ".join(f"('{r}', {c})" for r, c in tests)
    long = " UNION ALL ".join(f"SELECT doc_id, stratum, '{r}' AS rule, {r} AS x FROM f" for r in RULES)
    p = ALPHA / len(RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
m AS (SELECT doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, w FROM w),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM m WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
b AS (SELECT m.* EXCLUDE (w), CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM m LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_symbols / greatest(n_words, 1)::DOUBLE AS symbols_per_word, n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_share,
  n_repeat_words / greatest(n_words, 1)::DOUBLE AS repeat_word_share, word_chars / greatest(n_words, 1)::DOUBLE AS chars_per_word FROM b),
good AS (SELECT * FROM f WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
x AS ({long}),
grid AS (SELECT * FROM (VALUES {grid}) g(rule, cutoff)),
k AS (SELECT x.stratum, x.rule, cutoff, count(*) AS n, count_if(x.x > cutoff) AS k FROM x JOIN grid USING (rule)
  WHERE doc_id IN (SELECT doc_id FROM good) GROUP BY ALL),
test AS (SELECT *, list_sum(list_transform(range(0, CAST(k + 1 AS BIGINT)), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
  + j * ln({p}) + (n - j) * ln(1 - {p})))) AS tail, (SELECT count(DISTINCT stratum) FROM good) AS strata FROM k),
cuts AS (SELECT stratum, rule, min(cutoff) AS cut FROM test WHERE k <= n * {p} AND tail <= {DELTA} / (strata * {len(tests)}) GROUP BY ALL),
hit AS (SELECT x.doc_id, string_agg(x.rule, ',' ORDER BY list_position([{", ".join(f"'{r}'" for r in RULES)}], x.rule)) AS r
  FROM x JOIN cuts USING (stratum, rule) WHERE x.x > cut GROUP BY x.doc_id)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND hit.r IS NULL AS kept, coalesce(hit.r, '') AS rejected_by FROM f LEFT JOIN hit USING (doc_id)
"""


SQL = _sql()
