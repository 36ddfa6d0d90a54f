"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source's mean repetition rate is its share of the wished total over its own size, in
characters. Each document is repeated a Poisson number of times with that mean, found by
inverting the distribution at a hash of seed and doc_id: no state, no order, the same
answer whenever a task runs again. Means above ``PIECE`` are sums of independent smaller
ones, with a hash each. Copies are then dealt out by a hash of document and copy and
sorted by it in their partition, which shuffles them globally.

Nulls: a null source is a source of its own, a null text is empty, a null doc_id is
hashed as the empty string. A text counts one character more than it has, so no source is
without size. Repeated rows get the same count each. An empty table gives an empty result.
Other columns are kept, but for those named as the columns made here, which replace them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import documents, joined_small, settle

#: The largest mean that is inverted at once.
PIECE = 32.0
#: Entries of a distribution; the chance of more, at a mean of 32, is below 1e-30.
ENTRIES = 128


def uniform(seed: int, *parts: Column) -> Column:
    """A double in (0, 1) from 52 bits of the MD5 of seed and parts."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def distribution(mean: Column) -> Column:
    """P(X <= k) for k from 0 to ENTRIES - 1, X Poisson with this mean."""
    logs = [math.lgamma(k + 1) for k in range(ENTRIES)]
    terms = F.transform(F.array(*map(F.lit, logs)), lambda lg, k: F.exp(-mean + k * F.log(mean) - lg))
    sums = F.aggregate(
        terms,
        F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all")),
        lambda a, t: F.struct((a["sum"] + t).alias("sum"), F.concat(a["all"], F.array(a["sum"] + t)).alias("all")),
    )
    return sums["all"]


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.7, epochs: float = 1.0) -> DataFrame:
    """source_key, mean, pieces, cdf of every source.

    Without ``weights`` a source weighs its size to ``power``. Sources that ``weights``
    leaves out get none. The result is ``epochs`` times as large as the input.
    """
    sized = documents(docs, source_key(docs)).groupBy("source_key").agg(F.sum(F.length("text") + F.lit(1)).cast("double").alias("size"))
    if weights is None:
        weighed = sized.withColumn("weight", F.pow("size", F.lit(power)))
    else:
        given = docs.sparkSession.createDataFrame([("n" if k is None else f"s{k}", float(v)) for k, v in weights.items()], "source_key string, weight double")
        weighed = joined_small(sized, settle(given), "source_key").fillna(0.0, ["weight"])
    totals = weighed.agg(F.sum("weight").alias("weights"), F.sum("size").alias("sizes"))
    mean = F.col("weight") / F.col("weights") * F.col("sizes") * F.lit(float(epochs)) / F.col("size")
    found = weighed.join(F.broadcast(totals))  # one row
    found = found.select("source_key", mean.alias("mean")).where("mean > 0").withColumn("pieces", F.ceil(F.col("mean") / PIECE).cast("int"))
    return found.withColumn("cdf", distribution(F.col("mean") / F.col("pieces")))


def source_key(docs: DataFrame) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("source_key")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.7, epochs: float = 1.0, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` with n_copies, copy (from 1) and shuffle_key, in shuffled order."""
    made = settle(rates(docs, weights, power, epochs))
    names = [c for c in docs.columns if c not in ("n_copies", "copy", "shuffle_key")]
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    drawn = F.transform(
        F.sequence(F.lit(1), F.col("pieces")),
        lambda j: F.size(F.filter("cdf", lambda c: c < uniform(seed, text_id, j.cast("string")))),
    )
    count = F.aggregate(drawn, F.lit(0), lambda a, x: a + x)
    keyed = joined_small(docs.select(*names, source_key(docs)), made, "source_key", "inner")
    counted = keyed.withColumn("n_copies", count).where("n_copies > 0")
    copies = counted.select(*names, "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    copies = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed + 1), text_id, F.col("copy").cast("string")).cast("binary")))
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64(F.col("text").cast("string")))  # rows without doc_id share their keys
    return copies.repartition("shuffle_key", salt).sortWithinPartitions("shuffle_key", "doc_id", "copy")


#: The default mixture with DuckDB, for ``documents``.
SQL = f"""
WITH sized AS (
  SELECT source, sum(length(coalesce(text, '')) + 1)::DOUBLE AS size FROM documents GROUP BY source
), rated AS (
  SELECT source, pow(size, 0.7) / sum(pow(size, 0.7)) OVER () * sum(size) OVER () * 1.0 / size AS mean FROM sized
), pieced AS (
  SELECT source, ceil(mean / {PIECE})::INT AS pieces, mean / ceil(mean / {PIECE}) AS m FROM rated WHERE mean > 0
), terms AS (
  SELECT source, pieces, k, exp(-m + k * ln(m) - lgamma(k + 1)) AS p FROM pieced, range({ENTRIES}) AS r(k)
), cdf AS (
  SELECT source, pieces, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms
), draws AS (
  SELECT d.doc_id, d.source, d.text, d.lang, d.n_chars, j,
    (CAST('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, '') || ':' || j), 1, 13) AS BIGINT) + 0.5) / pow(2, 52) AS u
  FROM documents d JOIN pieced p ON d.source IS NOT DISTINCT FROM p.source, range(1, p.pieces + 1) AS r(j)
), counted AS (
  SELECT d.doc_id, d.source, any_value(d.text) AS text, any_value(d.lang) AS lang, any_value(d.n_chars) AS n_chars,
    count(c.k)::INT AS n_copies
  FROM draws d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.c < d.u GROUP BY d.doc_id, d.source
)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy::INT AS copy,
  md5('18:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) AS shuffle_key
FROM counted, range(1, n_copies + 1) AS r(copy)
"""
