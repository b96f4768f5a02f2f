"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is ``weight share x budget / size``, where sizes
are summed over all documents.  Each document draws a count from the Poisson
distribution with that mean: a uniform number from a hash of seed, id and text
is put through the inverse distribution function.  Means above ``MAX_RATE`` are
drawn as a sum of equal parts, each from a number of its own.  The document
appears that often, and all copies are put in one random order over the whole
output.

Nothing is drawn from a generator, so a retried task draws the same counts.

Defined results: a NULL source is a source of its own; documents of sources
without a weight, or with weight 0, get rate 0; a NULL or empty text has size
0 and is drawn like any other; repeated rows share one count and stay
repeated; a ``budget`` above ``MAX_BUDGET`` is refused, whatever the documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.llm.common import free_name
from prospectra.session import write_and_read_back

SEED = 17
# Share of a source in the mix: its size to this power, where no weights are given.
TEMPERATURE = 0.7
# The largest mean that one number draws.
MAX_RATE = 64.0
# The largest mix that may be asked for, as a multiple of the input.
MAX_BUDGET = 64.0


def source_rates(docs: DataFrame, source: str = "source", size: Column | None = None,
                 weights: dict[str, float] | None = None, temperature: float = TEMPERATURE,
                 budget: float = 1.0) -> DataFrame:
    """A written table (source, size, target, rate), one row per source.

    ``size`` measures a document, default its characters.  ``budget`` is the
    size of the mix as a multiple of the whole input.
    """
    if budget > MAX_BUDGET:
        raise ValueError(f"the input would be repeated {budget:.1f} times on average; the limit is {MAX_BUDGET}")
    size = F.coalesce(F.length("text"), F.lit(0)) if size is None else size
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size.cast("double")).alias("size"))
    if weights is None:
        raw = F.when(F.col("size") > 0, F.pow("size", F.lit(temperature))).otherwise(F.lit(0.0))
    else:
        raw = F.lit(0.0)
        for name, weight in weights.items():
            raw = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(raw)
    raw_sizes = sizes.withColumn("raw", raw)
    totals = raw_sizes.agg(F.sum("raw").alias("all_raw"), F.sum("size").alias("all_size"))
    target = F.when(F.col("all_raw") > 0, F.col("raw") / F.col("all_raw")).otherwise(F.lit(0.0))
    rate = F.when(F.col("size") > 0, F.col("target") * F.col("all_size") * budget / F.col("size")).otherwise(F.lit(0.0))
    # The one-row side is a total, so this is no product of two tables.
    rates = (raw_sizes.join(F.broadcast(totals), F.lit(True)).withColumn("target", target).withColumn("rate", rate)
             .select("source", "size", "target", "rate"))
    return write_and_read_back(rates, "source-rates")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts, 52 bits of it."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_count(u: Column, rate: Column, most: float = MAX_RATE) -> Column:
    """The smallest k whose Poisson distribution function exceeds ``u``; ``most`` bounds the rates.

    ``u`` and the rate travel in the running value: a step would work out
    anything that it names from outside again.
    """
    none = F.exp(-rate)
    start = F.struct(F.lit(0).alias("k"), none.alias("p"), none.alias("cdf"), u.alias("u"), rate.alias("rate"))
    steps = F.sequence(F.lit(1), F.lit(int(most + 10 * math.sqrt(most) + 20)))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * s["rate"] / i
        more = F.struct(i.alias("k"), p.alias("p"), (s["cdf"] + p).alias("cdf"), s["u"].alias("u"), s["rate"].alias("rate"))
        return F.when(s["u"] < s["cdf"], s).otherwise(more)

    return F.aggregate(steps, start, step, lambda s: s["k"])


def poisson_sum(u: Column, rate: Column, parts: list[Column], most: float) -> Column:
    """A Poisson number of any mean: ``poisson_count`` up to ``MAX_RATE``, beyond it the sum of
    equal parts of at most that mean, each drawn from a hash of ``parts`` and its number."""
    drawn = poisson_count(u, rate, min(most, MAX_RATE))
    if most <= MAX_RATE:
        return drawn
    n = F.ceil(rate / MAX_RATE)
    # All that a part needs is in its struct; names from outside would be worked out at every step.
    each = F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: F.struct(
        uniform(*parts, i).alias("u"), (rate / n).alias("rate")))
    many = F.aggregate(each, F.lit(0), lambda total, x: total + poisson_count(x["u"], x["rate"], MAX_RATE))
    return F.when(rate > MAX_RATE, many).otherwise(drawn)


def draw_counts(docs: DataFrame, rates: DataFrame, seed: int = SEED, doc_id: str = "doc_id", text: str = "text",
                source: str = "source", count: str = "copies") -> DataFrame:
    """``docs`` with the drawn number of copies.

    Rates of few sources reach the documents by a broadcast behind a size
    check; the planner decides, as ``rates`` is a written table.
    """
    name, rate = free_name(docs.columns, "rate_source"), free_name(docs.columns, "rate")
    most = rates.agg(F.max("rate")).first()[0] or 0.0
    rates = rates.select(F.col("source").alias(name), F.col("rate").alias(rate))
    parts = [F.lit(seed), F.col(doc_id), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))]
    return (docs.join(rates, F.col(source).eqNullSafe(F.col(name)), "left")
            .withColumn(count, poisson_sum(uniform(*parts), F.coalesce(F.col(rate), F.lit(0.0)), parts, most))
            .drop(name, rate))


def mix(docs: DataFrame, rates: DataFrame, seed: int = SEED, doc_id: str = "doc_id", text: str = "text",
        source: str = "source") -> DataFrame:
    """The mixed documents, each as often as drawn, in one random order.

    Copies are made after the draw and each gets its own random key; the sort
    by key is the global shuffle, so copies do not lie side by side.
    """
    count, copy, key = (free_name(docs.columns, n) for n in ("copies", "copy", "shuffle_key"))
    drawn = draw_counts(docs, rates, seed, doc_id, text, source, count).where(F.col(count) > 0)
    copies = drawn.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(count))))
    at = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text), F.col(copy))
    return copies.withColumn(key, at).orderBy(key).drop(count, copy, key)
