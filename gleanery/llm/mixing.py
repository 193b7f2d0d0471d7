"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated a Poisson number of times with mean rate(s) = target share * budget / size(s). The
number inverts the Poisson distribution at a uniform number hashed from seed and id, so it does not depend on partitions
or retries. A rate over PART_RATE is dealt out to equal parts, each with a hash of its own, whose draws are summed up: the
sum is Poisson with the whole rate, and exp(-rate) doesn't underflow. Each document is exploded by its count and the copies
are shuffled globally: every copy has a hashed place, is dealt out by it, and stands in its order. One hot source spreads
like any other, since places know no source.

Defined results: a null source is a source of its own (''); null text has size 0 but is repeated like its source; a row
with a null id draws as the id ''; rows that share an id and source draw alike; sources of size 0 or with no target get
rate 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import as_table, fresh, n_partitions

#: So many sources' rates are broadcast; beyond, they are joined by a salted key.
BROADCAST_SOURCES = 10_000
SALTS = 64
#: The largest rate that is drawn at once.
PART_RATE = 50.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest; SQL engines with md5 can repeat it."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def steps(limit: float) -> int:
    """Counts beyond this have a chance of under 2**-60 at the highest rate."""
    return int(limit + 12 * math.sqrt(limit) + 30)


def poisson(rate: Column, u: Column) -> Column:
    """The least k with u < P(X <= k), at most steps(PART_RATE)."""
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("below"))
    walk = F.aggregate(
        F.sequence(F.lit(1), F.least(F.lit(steps(PART_RATE)), (rate + 12 * F.sqrt(rate) + 30).cast("int"))),
        start,
        lambda s, i: F.when(
            u >= s["below"],
            F.struct((s["k"] + 1).alias("k"), (s["p"] * rate / i).alias("p"), (s["below"] + s["p"] * rate / i).alias("below")),
        ).otherwise(s),
        lambda s: s["k"],
    )
    return F.when(rate > 0, walk).otherwise(F.lit(0))


def copies(rate: Column, seed: str, name: Column) -> Column:
    """A Poisson number with any rate: one draw, or the sum of draws of at most PART_RATE each."""
    first = uniform(F.lit(seed), name)
    parts = F.ceil(rate / PART_RATE).cast("int")
    draw = lambda k: F.when(k == 0, first).otherwise(uniform(F.lit(seed), F.lit("part"), k.cast("string"), name))
    total = F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda n, k: n + poisson(rate / parts, draw(k)))
    return F.when(rate <= PART_RATE, poisson(rate, first)).otherwise(total)


def rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float, budget: float, source: Column, size: Column) -> DataFrame:
    """(mix_source, mix_rate): weights by source, or shares to the power `temperature`; budget as a share of all sizes."""
    sizes = as_table(docs.select(source.alias("mix_source"), size.alias("size")).groupBy("mix_source").agg(F.sum("size").alias("size")), "sizes")
    if weights is None:
        weighed = sizes.withColumn("w", F.pow(F.col("size").cast("double"), F.lit(temperature)))
    else:
        choice = F.lit(0.0)
        for name, w in weights.items():
            choice = F.when(F.col("mix_source") == name, F.lit(float(w))).otherwise(choice)
        weighed = sizes.withColumn("w", F.when(F.col("size") > 0, choice).otherwise(F.lit(0.0)))
    all_w, all_size = weighed.agg(F.sum(F.round("w", 6).cast("decimal(30,6)")).cast("double"), F.sum("size").cast("double")).first()
    rate = F.col("w") / F.lit(all_w) * F.lit(all_size) * F.lit(budget) / F.col("size")
    return weighed.select("mix_source", F.when((F.col("size") > 0) & F.lit(bool(all_w)), rate).otherwise(F.lit(0.0)).alias("mix_rate"))


ADDED = ("mix_rate", "mix_copies", "mix_copy", "mix_place")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, budget: float = 1.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", added: tuple[str, ...] = ADDED) -> DataFrame:
    """docs with the four added columns, one row for each copy, in a global hashed order.

    Columns of docs with the added names are replaced; other columns stay, whatever their names."""
    spark = docs.sparkSession
    docs = docs.drop(*added)
    as_rate, as_copies, as_copy, as_place = added
    of_source, salt = fresh("source"), fresh("salt")
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    size = F.coalesce(F.char_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    rate = as_table(rates(docs, weights, temperature, budget, source, size), "rates").withColumnsRenamed({"mix_source": of_source, "mix_rate": as_rate})
    keyed = docs.withColumn(of_source, source)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    if rate.count() <= BROADCAST_SOURCES:
        rated = keyed.join(F.broadcast(rate), of_source)
    else:
        salted = rate.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = keyed.withColumn(salt, F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int")).join(salted, [of_source, salt]).drop(salt)
    counted = rated.withColumn(as_copies, copies(F.col(as_rate), seed, name))
    repeated = counted.where(F.col(as_copies) > 0).withColumn(as_copy, F.explode(F.sequence(F.lit(0), F.col(as_copies) - 1)))
    placed = repeated.withColumn(as_place, uniform(F.lit(seed), F.lit("place"), name, F.col(as_copy).cast("string")))
    return placed.repartition(n_partitions(spark), as_place).sortWithinPartitions(as_place).drop(of_source)


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The copies with the columns of docs alone, all of them as they were."""
    return mix(docs, added=tuple(fresh(name) for name in ADDED), **how).select(*docs.columns)
