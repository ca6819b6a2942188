"""Mixing sources to target weights by Poisson replication. DataFrame functions only.

A source with target weight w and n documents is to be seen w * N / n times on average, N being the documents in all.
Each document draws its count from the Poisson distribution of that mean, by inverting it at a uniform number hashed
from seed, doc_id and text: the draw needs no state, gives the same counts on every run and however rows are dealt.
Copies are exploded and put in a random order by a hashed key, range-partitioned, so no task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import keep, own_names, quoted

#: Hex digits of a digest that make a uniform number; 13 of them (52 bits) are exact in a double.
_DIGITS = 13
#: Rates of up to so many sources are broadcast (some 10 MB); more are joined by a shuffle.
BROADCAST_SOURCES = 200_000
#: Copies that one row is exploded into by one task; rows of sources with more are dealt out in blocks of copies first.
BLOCK_COPIES = 1_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 digest of the parts, joined by a colon."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("long") / F.lit(float(16**_DIGITS))


def _inverse(mean: Column, at: Column) -> Column:
    """Smallest k with P(X <= k) > ``at`` for a Poisson X of a mean up to 500, summed term by term.

    Terms run to mean + 12 standard deviations + 40, beyond which no 52-bit number lies: no count is cut off.
    """
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    first = F.exp(-mean)
    start = F.struct(first.alias("term"), first.alias("sum"), F.lit(0).alias("k"))

    def step(state: Column, k: Column) -> Column:
        term = state["term"] * mean / k
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"), F.when(state["sum"] <= at, k).otherwise(state["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["k"])


def poisson_count(mean: Column, *parts: Column) -> Column:
    """A Poisson number of the given mean, drawn by the hash of the parts; means above 500 as sums of equal parts."""
    pieces = F.greatest(F.ceil(mean / 500), F.lit(1)).cast("int")
    draw = lambda got, piece: got + _inverse(mean / pieces, uniform(*parts, piece))
    return F.aggregate(F.sequence(F.lit(1), pieces), F.lit(0), draw)


def rates(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``source``, ``rate``: the mean number of copies; one row a source.

    ``weights`` are shares of the mix and are scaled to sum to 1; None means equal shares of all sources there are. A
    source without a weight gets none of its documents; a null source is one of its own, named by ''. Counting is
    combined map-side; two numbers reach the driver.
    """
    counts = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("_n"))
    counts = keep(counts, "sources")
    total, sources = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))).first()
    share = F.lit(1.0 / max(sources, 1) if weights is None else 0.0)
    for name, weight in (weights or {}).items():
        share = F.when(F.col("source") == name, weight / sum(weights.values())).otherwise(share)
    return counts.select("source", (share * total / F.col("_n")).alias("rate"))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """Every column of ``docs`` with ``copy`` (from 0) and ``shuffle_key``, in the order of the key.

    Needs ``doc_id``, ``text``, ``source``, of which each may be null. A document drawn 0 times is left out, as the method
    has it. Rows equal in doc_id and text draw the same number. Columns named ``copy`` or ``shuffle_key`` are replaced; all
    others pass through, whatever their names. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    plain = docs.drop("copy", "shuffle_key")
    source, rate, count, block = own_names(plain, "mix_source", "mix_rate", "mix_count", "mix_block")
    known = keep(rates(plain, weights).select(F.col("source").alias(source), F.col("rate").alias(rate)), "rates")
    sources, most = known.agg(F.count(F.lit(1)), F.coalesce(F.max(rate), F.lit(0.0))).first()
    if sources <= BROADCAST_SOURCES:
        known = F.broadcast(known)
    rows = plain.withColumn(source, F.coalesce(F.col("source").cast("string"), F.lit(""))).join(known, source)
    words = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    drawn = F.when(F.col(rate) > 0, poisson_count(F.col(rate), F.lit(seed), F.col("doc_id"), words)).otherwise(0)
    counted = rows.withColumn(count, drawn).where(F.col(count) > 0)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    # Copies come in blocks, so that no array holds all of a row; many of them are dealt out before they are made.
    blocks = F.sequence(F.lit(0), F.floor((F.col(count) - 1) / BLOCK_COPIES).cast("int"))
    dealt = counted.withColumn(block, F.explode(blocks))
    if most > BLOCK_COPIES:
        dealt = dealt.repartition(parts, F.col(block), words)
    first = F.col(block) * BLOCK_COPIES
    copies = dealt.withColumn("copy", F.explode(F.sequence(first, F.least(first + BLOCK_COPIES, F.col(count)) - 1)))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), words, F.col("copy").cast("string")))
    keyed = copies.withColumn("shuffle_key", key).select(*map(quoted, plain.columns), "copy", "shuffle_key")
    # Keys are uniform by construction: equal ranges of their first digits need no sampling pass over the copies.
    place = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * parts / F.lit(16**8)).cast("int")
    return keyed.repartitionById(parts, place).sortWithinPartitions("shuffle_key", "copy")
