"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

A source's documents are each repeated a Poisson number of times whose mean is
the source's target share over its present share. The number is found by
inverting the distribution at a hash of the document's id, so it does not
depend on partitions or on reruns. The copies then go to places that a hash
of id and copy names: a shuffle of the whole mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spare, staged

SEED = "mixture"
#: Means above this are sums of equal parts, each drawn by itself: exp(-mean) must not vanish.
PART = 200.0
#: Sources whose rates may be sent to every task; beyond it they are joined by shuffle, salted.
FEW, SALTS = 10_000, 64


def _uniform(*parts: Column) -> Column:
    """52 bits of an MD5, as a number from 0 to under 1."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _sums(mean: Column) -> Column:
    """P(at most k) for k from 0 until the rest cannot be told from nothing."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.array(F.exp(-mean)).alias("sums"), F.exp(-mean).alias("p"))
    def more(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + p)).alias("sums"), p.alias("p"))

    return F.aggregate(F.sequence(F.lit(1), last), start, more, lambda acc: acc["sums"])


def rates(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source", temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(_source, n, mean): documents and mean repetitions of each source that docs have.

    weights: (source_col, weight), any scale; sources that it lacks, and those
    with a null or negative weight, get 0. Without it the weight is the number
    of documents to the power of `temperature`. A null source is a source.
    `epochs` times as many documents come out as docs have, on average.
    """
    sizes = docs.groupBy(F.col(source_col).alias("_source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighted = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        own = weights.groupBy(F.col(source_col).alias("_s")).agg(F.max("weight").cast("double").alias("w"))
        joined = sizes.join(own, F.col("_source").eqNullSafe(F.col("_s")), "left")
        weighted = joined.select("_source", "n", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)).alias("w"))
    total = weighted.agg(F.sum("n").alias("all"), F.sum("w").alias("sum")).first()
    every, weight = total["all"] or 0, total["sum"] or 1.0
    return weighted.select("_source", "n", (F.lit(float(every) * epochs) * F.col("w") / F.lit(float(weight)) / F.col("n")).alias("mean"))


def mixed(
    docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source",
    temperature: float = 0.5, epochs: float = 1.0, seed: str = SEED,
) -> DataFrame:
    """docs' columns, with repeats, copy (from 1) and shuffle_key, in the order of the mixture.

    One row for each copy; documents that draw 0 are not in the mixture. The
    order: by partition, and by shuffle_key within it. A null id is drawn as
    the empty text, and rows that repeat an id draw the same number. An empty
    table gives an empty one. Columns of docs named like the new ones give way.
    """
    plain = docs.drop("repeats", "copy", "shuffle_key")
    key, parts, sums, salt, deal = (spare(c, plain) for c in ("_source", "_parts", "_sums", "_salt", "_deal"))
    own = rates(docs, weights, source_col, temperature, epochs)
    own = own.select(F.col("_source").alias(key), "mean", F.greatest(F.lit(1), F.ceil(F.col("mean") / PART)).cast("int").alias(parts))
    own = staged(own.select(key, parts, _sums(F.col("mean") / F.col(parts)).alias(sums)), "rates")
    few = own.limit(FEW + 1).count() <= FEW
    same = F.col(source_col).eqNullSafe(F.col(key))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    if few:
        joined = plain.join(F.broadcast(own), same)
    else:
        salted = own.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = plain.withColumn(deal, F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, same & (F.col(deal) == F.col(salt)))

    def drawn(n: Column, part: Column) -> Column:
        u = _uniform(F.lit(seed), name, part.cast("string"))
        return n + F.size(F.filter(sums, lambda s: s <= u))

    repeats = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), drawn)
    copies = joined.withColumn("repeats", repeats).where("repeats > 0").drop(key, parts, sums, salt, deal)
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    order = F.md5(F.concat_ws(":", F.lit("order"), F.lit(seed), name, F.col("copy").cast("string")).cast("binary"))
    copies = copies.withColumn("shuffle_key", F.substring(order, 1, 16))
    return copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def oracle(temperature: float = 0.5, seed: str = SEED) -> str:
    """DuckDB SQL for mixed() over documents, for means up to PART."""
    return f"""
    WITH sizes AS (SELECT source, count(*) AS n, pow(count(*), {temperature}) AS w FROM documents GROUP BY source),
    means AS (
      SELECT source, (SELECT count(*) FROM documents) * w / (SELECT sum(w) FROM sizes) / n AS mean FROM sizes
    ),
    terms AS (
      SELECT source, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS p
      FROM means, (SELECT unnest(range(0, 400)) AS k)
    ),
    sums AS (
      SELECT source, list(s ORDER BY s) AS sums
      FROM (SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS s FROM terms) GROUP BY source
    ),
    drawn AS (
      SELECT d.*, len(list_filter(sums, lambda s: s <=
        ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':1'), 1, 13))::BIGINT / 4503599627370496.0)) AS repeats
      FROM documents d JOIN sums ON d.source IS NOT DISTINCT FROM sums.source
    ),
    copies AS (SELECT *, unnest(range(1, repeats + 1)) AS copy FROM drawn WHERE repeats > 0)
    SELECT doc_id, text, lang, source, n_chars, repeats::INT AS repeats, copy::INT AS copy,
      substr(md5('order:{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 16) AS shuffle_key
    FROM copies
    """
