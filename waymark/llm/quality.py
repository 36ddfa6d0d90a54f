"""Quality rules with cutoffs whose false rejections are limited, in DataFrame operations only.

Each rule rejects documents whose measure reaches a cutoff from a fixed grid. In each
stratum (language) the documents labelled good test every cutoff: the exact binomial test
asks whether the share of good documents it rejects can be ``ALPHA`` over the number of
rules. Cutoffs are tested from the mildest on, so one grid needs no correction; the level
``DELTA`` is shared out over strata and rules (Bonferroni). Hence with confidence 1 -
``DELTA`` all strata reject at most ``ALPHA`` of their good documents. Of the cutoffs that
pass, a rule takes the one that rejects most bad documents, a good one costing ``PRICE``
of them. Strata with too few labels to prove anything get no cutoff, and keep all.

Everything about a text is computed within its row, so no text is shuffled.

Nulls: a null text has no words and fails the base rules; a null language is a stratum of
its own; labels with a null quality don't count, of several labels for one id the lowest
does. Repeated rows are judged once each. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import joined_small, may_have, settle

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
ALPHA, DELTA, PRICE = 0.05, 0.05, 10

_SHARES = [1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02]
_COUNTS = [4.0, 3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02]
_LENGTHS = [40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 15.0, 14.0, 13.0, 12.0, 11.0, 10.5, 10.0, 9.5, 9.0, 8.5, 8.0, 7.5, 7.0, 6.5]
#: Measure as numerator and denominator, and cutoffs from the mildest on.
RULES: dict[str, tuple[str, str, list[float]]] = {
    "symbols": ("n_symbols", "n_words", _COUNTS),
    "marks": ("n_marks", "n_words", _COUNTS),
    "repeats": ("n_repeat_words", "n_words", _SHARES),
    "dup_lines": ("n_dup_lines", "n_lines", _SHARES),
    "capitals": ("n_capitals", "word_chars", _SHARES),
    "word_length": ("word_chars", "n_words", _LENGTHS),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("bigint")


def _repeat_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that occur twice or more."""

    def covered(h: Column) -> Column:
        def dup(s: Column) -> Column:
            return F.filter(
                F.transform(s, lambda e, i: F.when((F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"]), e["i"])),
                lambda x: x.isNotNull(),
            )

        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(
            F.sort_array(let(placed, dup)),
            lambda p: F.aggregate(
                F.transform(p, lambda q, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - q, F.lit(width)))),
                F.lit(0), lambda a, x: a + x,
            ),
        )

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) < width, F.lit(0)).otherwise(found)


def measures(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, stratum, the columns in ``more``, the counts of each text, base_failed, and for each rule how many cutoffs are above its measure."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(
        *more, F.col("doc_id").cast("bigint").alias("__id"),
        F.coalesce(F.concat(F.lit("s"), F.col("lang").cast("string")), F.lit("n")).alias("__stratum"),
        text.alias("__text"),
    )
    t = F.col("__text")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    counted = own.withColumn(
        "__m",
        F.struct(
            let(
                F.filter(F.split(t, SPACE), lambda w: w != ""),
                lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), _repeat_words(w).cast("bigint").alias("n_repeat_words")),
            ).alias("w"),
            let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))).alias("l"),
            F.length(F.translate(t, BLANKS, "")).cast("bigint").alias("word_chars"),
            _count_of(t, SYMBOLS).alias("n_symbols"),
            _count_of(t, "!?").alias("n_marks"),
            _count_of(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        ),
    )
    m = F.col("__m")
    flat = counted.select(
        *more, F.col("__id").alias("doc_id"), F.col("__stratum").alias("stratum"),
        m["w"]["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"),
        m["l"]["n_dup_lines"].alias("n_dup_lines"), m["w"]["n_repeat_words"].alias("n_repeat_words"),
        m["l"]["n_lines"].alias("n_lines"), m["n_marks"].alias("n_marks"), m["n_capitals"].alias("n_capitals"),
    )

    def above(a: str, b: str, grid: list[float]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, grid)), lambda c: c > F.col(a) / F.greatest(F.col(b), F.lit(1))))

    reached = F.array(*(above(*rule) for rule in RULES.values()))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return flat.withColumn("base_failed", failed).withColumn("reached", reached)


def _log_gamma(x: Column) -> Column:
    """By Stirling's series eight places on; exact to about 1e-12 from 1 on."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for k in range(8):
        series = series - F.log(x + float(k))
    return series


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k), X binomial; 1 where k is above the mean, which no test needs closer."""
    k, n = k.cast("double"), n.cast("double")
    top = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    steps = F.least(k, F.ceil(40 * F.sqrt(n * p)) + 50).cast("int")  # further terms are too small to count
    total = F.aggregate(
        F.sequence(F.lit(0), steps),
        F.struct(F.exp(top).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct((a["term"] * (k - i) * (1 - p) / ((n - k + i + 1) * p)).alias("term"), (a["sum"] + a["term"]).alias("sum")),
    )["sum"]
    return F.when(k > n * p, F.lit(1.0)).otherwise(total)


def cutoffs(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, cut: for each rule the place of its cutoff in the grid, -1 for none."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = measured.select("doc_id", "stratum", "reached").join(known, "doc_id")
    steps = labelled.select("stratum", "quality", F.posexplode("reached").alias("rule", "at"))
    counts = steps.groupBy("stratum", "rule", "at").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    grid = len(_SHARES)
    up = Window.partitionBy("stratum", "rule").orderBy("at")
    every = Window.partitionBy("stratum", "rule")
    sums = counts.select(
        "stratum", "rule", "at",
        F.sum("good").over(up).alias("lost"), F.sum("bad").over(up).alias("caught"), F.sum("good").over(every).alias("n"),
    )
    strata = counts.agg(F.count_distinct("stratum").alias("strata"))
    level = F.lit(DELTA) / (F.col("strata") * len(RULES))
    tested = sums.where(F.col("at") < grid).join(F.broadcast(strata))
    passed = tested.where((F.col("n") > 0) & (binomial_tail(F.col("lost"), F.col("n"), ALPHA / len(RULES)) <= level))
    worth = F.col("caught") - PRICE * F.col("lost")
    best = passed.groupBy("stratum", "rule").agg(F.max(F.struct(worth.alias("worth"), (-F.col("at")).alias("at"))).alias("best"))
    best = best.where("best.worth > 0").groupBy("stratum").agg(F.collect_list(F.struct("rule", (-F.col("best.at")).alias("at"))).alias("found"))

    def of(rule: int) -> Column:
        return F.coalesce(F.get(F.filter("found", lambda x: x["rule"] == rule), F.lit(0))["at"], F.lit(-1))

    return best.select("stratum", F.array(*map(of, range(len(RULES)))).alias("cut"))


def judged(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """``measured`` with kept; ``cuts`` is settled."""
    joined = joined_small(measured, cuts, "stratum")
    none = F.array(*[F.lit(-1)] * len(RULES))
    rejected = F.exists(F.zip_with("reached", F.coalesce("cut", none), lambda a, c: a <= c), lambda x: x)
    # one condition, so that no part of it is pushed below, where it would measure texts again
    return joined.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(~rejected)).drop("cut")


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The measures of every row with kept."""
    measured = settle(measures(docs))
    return judged(measured, settle(cutoffs(measured, labels)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept. Each text is measured once.

    What is rejected is known by two 64-bit hashes of a row's id, language and text. Only
    rows that a filter of bounded size doesn't clear are shuffled to find out.
    """
    parts = [F.col("doc_id"), F.col("lang").cast("string"), F.col("text").cast("string")]
    own = docs.withColumns({"__key": F.xxhash64(*parts), "__check": F.xxhash64(F.lit(1), *reversed(parts))})
    measured = settle(measures(own, "__key", "__check").select("__key", "__check", "doc_id", "stratum", "base_failed", "reached"))
    gone = settle(judged(measured, settle(cutoffs(measured, labels))).where("not kept").select("__key", "__check").distinct())
    apart = may_have(own, "__key", gone)
    rest = apart.where("maybe").join(gone, ["__key", "__check"], "left_anti")
    return apart.where("not maybe").unionByName(rest.select(apart.columns)).select(docs.columns)


def _sql() -> str:
    reached = ", ".join(
        f"len(list_filter([{', '.join(map(str, grid))}]::DOUBLE[], lambda c: c > {a}::DOUBLE / greatest({b}, 1)))" for a, b, grid in RULES.values()
    )
    white = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH t AS (
  SELECT doc_id, coalesce('s' || lang, 'n') AS stratum, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '{white}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{white}')) AS lines FROM t
), grams AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), repeats AS (
  SELECT doc_id, sum(least(5, coalesce(after - i, 5)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM twice) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, stratum, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines, (length(text) - length(regexp_replace(text, '[!?]', '', 'g')))::BIGINT AS n_marks,
    (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals
  FROM w LEFT JOIN repeats r ON w.doc_id = r.doc_id
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, [{reached}] AS reached FROM m
), known AS (
  SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id
), steps AS (
  SELECT stratum, quality, unnest(reached) AS place, generate_subscripts(reached, 1) AS rule FROM f JOIN known USING (doc_id)
), counts AS (
  SELECT stratum, rule, place, sum(quality) AS good, sum(1 - quality) AS bad FROM steps GROUP BY ALL
), sums AS (
  SELECT stratum, rule, place, sum(good) OVER u AS lost, sum(bad) OVER u AS caught, sum(good) OVER (PARTITION BY stratum, rule) AS n FROM counts
  WINDOW u AS (PARTITION BY stratum, rule ORDER BY place)
), tails AS (
  SELECT stratum, rule, place, lost, caught,
    CASE WHEN lost > n * {ALPHA / len(RULES)!r} THEN 1 ELSE list_sum(list_transform(range(0, lost::BIGINT + 1),
      lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA / len(RULES)!r}) + (n - j) * ln(1 - {ALPHA / len(RULES)!r})))) END AS p
  FROM sums WHERE place < {len(_SHARES)} AND n > 0
), best AS (
  SELECT stratum, rule, arg_min(place, (-(caught - {PRICE} * lost), place)) AS cut, max(caught - {PRICE} * lost) AS worth
  FROM tails WHERE p <= {DELTA} / ((SELECT count(DISTINCT stratum) FROM counts) * {len(RULES)}) GROUP BY stratum, rule
), rejected AS (
  SELECT DISTINCT doc_id FROM (SELECT doc_id, stratum, unnest(reached) AS place, generate_subscripts(reached, 1) AS rule FROM f) x
  JOIN best USING (stratum, rule) WHERE worth > 0 AND x.place <= best.cut
)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND r.doc_id IS NULL AS kept FROM f LEFT JOIN rejected r ON f.doc_id = r.doc_id
"""


SQL = _sql()
