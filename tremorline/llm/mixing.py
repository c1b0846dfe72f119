"""Mixing sources to target weights by Poisson replication."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorline.llm.text import key_text, uniform, whole, without
from tremorline.session import materialize

#: A larger mean is drawn as a sum of equal parts of at most this mean, so that exp(-mean) keeps its digits.
PART_MEAN = 16.0
#: Terms of the cumulative distribution of one part; beyond them its tail is under 2**-53 for a mean of 16.
TERMS = 100


def tempered_weights(docs: DataFrame, temperature: float = 0.5) -> DataFrame:
    """``(source, weight)`` with weight = 1000 * bytes ** temperature, rounded to a whole number."""
    return docs.groupBy("source").agg(F.sum(_size()).alias("_bytes")).select(
        "source", F.round(F.pow(F.col("_bytes").cast("double"), F.lit(temperature)) * 1000).cast("long").alias("weight"))


def _size() -> Column:
    return F.octet_length(whole("text")).cast("long") + 1


def repetition_rates(docs: DataFrame, weights: DataFrame, epochs: float = 1.0) -> DataFrame:
    """``(source, rate)``: how often a document of the source is to appear on average.

    The mixture has ``epochs`` times the bytes of ``docs``, shared out by weight among the sources that have both rows and a
    weight above 0; other sources get no row. A null source is a source like any other.
    """
    given = weights.select(F.col("source").alias("_source"), F.col("weight").alias("_weight"))
    sizes = docs.groupBy("source").agg(F.sum(_size()).alias("_bytes"))
    both = sizes.join(given, F.col("source").eqNullSafe(F.col("_source"))).filter(F.col("_weight") > 0)
    weight_sum = both.agg(F.sum("_weight").alias("all")).scalar()
    byte_sum = docs.agg(F.sum(_size()).alias("all")).scalar()
    share = F.col("_weight").cast("double") / weight_sum.cast("double")
    return both.select("source", (share * byte_sum.cast("double") * F.lit(float(epochs)) / F.col("_bytes").cast("double"))
                       .alias("rate"))


def _cumulative(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson distribution."""
    start = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("total"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * mean / k.cast("double")
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"),
                        F.concat(acc["cdf"], F.array(acc["total"] + term)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["cdf"])


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0, seed: int = 0) -> DataFrame:
    """Every document 0, 1, 2, ... times, so that sources meet their weights, in one global random order.

    A document's number of copies is Poisson with the rate of its source: uniform numbers hashed from doc_id and
    ``seed`` are pushed through the inverse distribution. It becomes rows with ``copy`` 1..n, ``rate`` and ``mix_key``, a
    hash of doc_id, copy and text; rows are dealt and sorted by ``mix_key``, which orders the whole mixture at random.
    The same input, weights and seed give the same rows. ``weights`` has (source, weight); without it, sources weigh by the
    square root of their bytes. Rows sharing a doc_id (or having none) get equal counts; null texts count one byte;
    input columns named copy, rate or mix_key are replaced. No rows in, no rows out.
    """
    docs = without(docs, "copy", "rate", "mix_key", "_source", "_parts", "_cdf", "_copies")
    rates = repetition_rates(docs, tempered_weights(docs) if weights is None else weights, epochs)
    parts = F.greatest(F.ceil(F.col("rate") / PART_MEAN), F.lit(1)).cast("int")
    rates = rates.select(F.col("source").alias("_source"), "rate", parts.alias("_parts")).withColumn(
        "_cdf", _cumulative(F.col("rate") / F.col("_parts").cast("double")))
    # Stored, its size is known before the join is planned: a small table is broadcast and the documents stay where they are.
    rates = materialize(rates, "rates")

    def draw(part: Column) -> Column:
        u = uniform(F.lit(f"copies {seed}"), F.col("doc_id"), part)
        return F.size(F.filter("_cdf", lambda c: c < u))

    copies = F.aggregate(F.sequence(F.lit(1), F.col("_parts")), F.lit(0), lambda n, part: n + draw(part))
    repeated = (
        docs.join(rates, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_copies", copies)
        .filter("_copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .withColumn("mix_key", F.md5(key_text(F.lit(f"order {seed}"), F.col("doc_id"), F.col("copy"),
                                              F.crc32(whole("text").cast("binary"))).cast("binary")))
    )
    return (
        repeated.select(*[F.col(f"`{c}`") for c in docs.columns], "copy", "rate", "mix_key")
        .repartition("mix_key").sortWithinPartitions("mix_key")
    )
