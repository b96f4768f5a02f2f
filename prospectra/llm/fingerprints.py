"""Document fingerprints by consistent weighted sampling.

A text is a bag of five-word shingles weighted by their counts.  For every
sample number a shingle draws ``r`` and ``c`` from Gamma(2, 1) and ``beta``
from the unit interval, all from hashes of shingle and number.  A shingle of
weight ``w`` takes the step ``t = floor(ln w / r + beta)`` and the value
``a = c exp(-r (t - beta + 1))``; the smallest value of a text is its sample,
named by shingle and step.  Two texts agree in a sample with a probability
equal to the generalised Jaccard similarity of their bags, so the share of
equal positions of two fingerprints estimates it.

Gamma(2, 1) is the sum of two exponentials, and one's share of the sum is
uniform and independent of it.  So four exponentials ``e1 .. e4`` give all:
``c = e3 + e4``, ``r = e1 + e2`` with ``e1 = -ln(e3 / c)``, ``beta = e2 / r``.  For
weight 1, by far the most frequent, the step is 0 and the value comes to ``e3``.
Values are kept as ``1 - exp(-a)``, which keeps their order, and for weight 1
that is a plain uniform number: the bits of a hash, without any logarithm.

Only built-in functions are used.  A shingle common to two versions of a text
with equal weight is sampled once for both.

Defined results: a NULL text is empty; texts without words share one sign of
their own, so they are alike among themselves and unlike all others; texts with
fewer than five words have one shingle; repeated rows are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
# Samples are worked in blocks, so that the compiled loop stays small.
BLOCKS, BLOCK = 8, 8
SAMPLES = BLOCKS * BLOCK
_DIGITS = 4                      # hexadecimal digits per sample
_SCALE = float(1 << 46)
_UNIT = float(1 << 32)

# Texts of about so many characters are worked in one task.
PARTITION_CHARS = 2 << 20
MOST_PARTITIONS = 65_536
_BUCKETS_PER_PARTITION = 4


def shingle_hashes(text: Column) -> Column:
    """The 64-bit hashes of a text's shingles, with repeats; never empty."""
    words = F.transform(F.array_remove(F.split(text, "[ \\t-\\r]+"), ""), lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - SHINGLE)
        long = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))
        return F.when(F.size(h) >= SHINGLE, long).otherwise(F.array(F.xxhash64(h, F.size(h))))

    # The inner function gets the word hashes as a value, so they are made once.
    return F.get(F.transform(F.array(words), windows), F.lit(0))


def _bits(term: Column, number: Column) -> Column:
    """46 bits, uniform: the scaled value of weight 1."""
    return F.shiftrightunsigned(F.xxhash64(term, number), 18)


def _packed(term: Column, value: Column, step: Column) -> Column:
    """A sample as one number: the value decides the order, the last digits name shingle and step."""
    return F.shiftleft(value, 16).bitwiseOR((F.shiftrightunsigned(term, 7) + step * 40503).bitwiseAND(F.lit(0xFFFF)))


def _other_weight(term: Column, weight: Column, number: Column) -> Column:
    """The sample of a shingle whose weight is not 1."""
    more = F.xxhash64(term, -number - 1)
    e3 = -F.log1p(-(_bits(term, number) + 0.5) / _SCALE)
    e4 = -F.log((F.shiftrightunsigned(more, 32) + 0.5) / _UNIT)
    e2 = -F.log((more.bitwiseAND(F.lit(0xFFFFFFFF)) + 0.5) / _UNIT)
    c = e3 + e4
    e1 = -F.log(e3 / c)
    r, beta = e1 + e2, e2 / (e1 + e2)
    step = F.floor(F.log(weight.cast("double")) / r + beta)
    value = -F.expm1(-c * F.exp(-r * (step - beta + 1)))
    return _packed(term, F.least((value * _SCALE).cast("long"), F.lit((1 << 46) - 1)), step)


def _hex(sample: Column) -> Column:
    return F.lpad(F.hex(sample.bitwiseAND(F.lit(0xFFFF))), _DIGITS, "0")


def fingerprints(rows: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """The keys with the fingerprints of two shingle-hash columns, named ``first`` and ``second``.

    Where ``rows`` is already partitioned by one of the keys, no shuffle is
    added: counting and sampling both group by all keys.
    """
    size = F.size(first).alias("_size")
    terms = rows.select(*keys, size, F.posexplode(F.concat(first, second)).alias("_at", "_term"))
    in_first = F.col("_at") < F.col("_size")
    weights = terms.groupBy(*keys, "_term").agg(F.sum(in_first.cast("long")).alias("_w1"),
                                                F.sum((~in_first).cast("long")).alias("_w2"))

    def version(weight: str, mask: int) -> Column:
        return F.struct(F.col(weight).alias("w"), F.lit(mask).alias("m"))

    versions = (F.when(F.col("_w1") == F.col("_w2"), F.array(version("_w1", 3)))
                .when(F.col("_w2") == 0, F.array(version("_w1", 1)))
                .when(F.col("_w1") == 0, F.array(version("_w2", 2)))
                .otherwise(F.array(version("_w1", 1), version("_w2", 2))))
    weighted = weights.select(*keys, "_term", F.explode(versions).alias("_v")).select(*keys, "_term", "_v.w", "_v.m")
    # Other weights are worked in a higher-order function, which also keeps the loop below, compiled
    # as one method, short enough for the compiler of the virtual machine.
    one = F.col("w") == 1
    rare = F.when(~one, F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda i: _other_weight(
        F.col("_term"), F.col("w"), i)))
    blocks = weighted.select(*keys, "_term", "m", one.alias("_one"), rare.alias("_rare")).select(
        "*", F.explode(F.array(*[F.lit(b * BLOCK) for b in range(BLOCKS)])).alias("_block"))
    samples = blocks.select(*keys, "_block", "m", *[
        F.when(F.col("_one"), _packed(F.col("_term"), _bits(F.col("_term"), F.col("_block") + i), F.lit(0)))
        .otherwise(F.get("_rare", F.col("_block") + i)).alias(f"_s{i}") for i in range(BLOCK)])
    least = samples.groupBy(*keys, "_block").agg(*[
        F.min(F.when(F.col("m").bitwiseAND(F.lit(mask)) > 0, F.col(f"_s{i}"))).alias(f"_{mask}_{i}")
        for mask in (1, 2) for i in range(BLOCK)])
    signs = least.select(*keys, *[
        F.struct("_block", F.concat(*[_hex(F.col(f"_{mask}_{i}")) for i in range(BLOCK)]).alias("s")).alias(f"_{mask}")
        for mask in (1, 2)])
    joined = [F.array_join(F.transform(F.array_sort(F.collect_list(f"_{mask}")), lambda x: x["s"]), "").alias(name)
              for mask, name in ((1, first), (2, second))]
    return signs.groupBy(*keys).agg(*joined)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal positions of two fingerprints."""
    def add(total: Column, i: Column) -> Column:
        at = i * _DIGITS + 1
        return total + (a.substr(at, F.lit(_DIGITS)) == b.substr(at, F.lit(_DIGITS))).cast("int")
    return F.aggregate(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), F.lit(0), add) / SAMPLES


# Texts and their edited versions ---------------------------------------------

def _cut_points(rows: DataFrame, buckets: int) -> list[tuple[int | None, int]]:
    """The first (id, text hash) of each of about ``buckets`` ranges of all rows, in order.

    Any cut points give the same result; these make the ranges even.
    """
    keys = rows.select("doc_id", "text_hash").repartitionByRange(buckets, "doc_id", "text_hash")
    first = keys.groupBy(F.spark_partition_id()).agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
    return [tuple(r) for r in first.select("k.*").distinct().orderBy("doc_id", "text_hash").collect()]


def _place(cuts: list[tuple[int | None, int]]) -> tuple[Column, Column]:
    """A row's 1-based range, and whether it is the first of it, by binary search.

    A NULL id comes before all others.
    """
    lowest = -(1 << 63)
    ids, hashes = F.lit([lowest if i is None else i for i, _ in cuts]), F.lit([h for _, h in cuts])
    n = len(cuts)
    key = F.struct(F.coalesce("doc_id", F.lit(lowest)).alias("i"), F.col("text_hash").alias("h"))

    def cut(at: Column) -> Column:
        return F.struct(F.element_at(ids, at).alias("i"), F.element_at(hashes, at).alias("h"))

    def step(found: Column, width: Column) -> Column:
        probe = found + width
        return F.when((probe <= n) & (cut(F.least(probe, F.lit(n))) <= key), probe).otherwise(found)

    widths = [1 << b for b in reversed(range(n.bit_length()))]
    found = F.aggregate(F.array(*[F.lit(w) for w in widths]), F.lit(0), step)
    return found, cut(F.greatest(found, F.lit(1))) == key


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, place, tail, doc_id, text, next_text): each row with the text that follows it by id.

    Rows are dealt into ranges of ascending id (then text hash, then text);
    the first row of a range also goes, as ``tail``, to the end of the range
    before, and the first of all to the end of the last.  So a range knows its
    followers, and texts are shuffled once.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    chars = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = int(min(MOST_PARTITIONS, chars // PARTITION_CHARS + 1))
    cuts = _cut_points(rows, min(MOST_PARTITIONS, parts * _BUCKETS_PER_PARTITION))
    if not cuts:
        return rows.select(F.lit(1).alias("bucket"), F.lit(1).alias("place"), F.lit(False).alias("tail"), "doc_id", "text",
                           F.lit("").alias("next_text"))
    found, is_first = _place(cuts)
    before = F.when(found == 1, F.lit(len(cuts))).otherwise(found - 1)
    own = F.struct(found.alias("bucket"), F.lit(False).alias("tail"))
    placed = rows.select("doc_id", "text_hash", "text", F.explode(
        F.when(is_first, F.array(own, F.struct(before.alias("bucket"), F.lit(True).alias("tail")))).otherwise(F.array(own)))
        .alias("p")).select("p.*", "doc_id", "text_hash", "text").repartition(parts, "bucket")
    order = Window.partitionBy("bucket").orderBy("tail", F.col("doc_id").asc_nulls_first(), "text_hash", "text")
    return placed.select("bucket", F.row_number().over(order).alias("place"), "tail", "doc_id", "text",
                         F.coalesce(F.lead("text").over(order), F.lit("")).alias("next_text"))


def compare_with_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited versions, and the likenesses.

    The edited version replaces the last quarter of the characters by as many
    first ones of the next document.  The branch that samples and the branch
    that describes read one and the same shuffle.
    """
    rows = with_next(docs, doc_id, text)
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int")),
                      F.substring("next_text", F.lit(1), F.floor(n / 4).cast("int")))
    rows = rows.withColumn("edited", edited)
    terms = rows.select("bucket", "place", shingle_hashes(F.col("text")).alias("fingerprint"),
                        F.when(F.col("tail"), F.array().cast("array<bigint>")).otherwise(shingle_hashes(F.col("edited")))
                        .alias("edited_fingerprint"))
    signs = fingerprints(terms, ["bucket", "place"], "fingerprint", "edited_fingerprint")
    about = rows.select("bucket", "place", "tail", "doc_id", F.length("text").cast("long").alias("n_chars"),
                        F.sha2(F.col("edited"), 256).alias("edited_sha256"))
    order = Window.partitionBy("bucket").orderBy("place")
    met = signs.join(about, ["bucket", "place"]).withColumn("next", F.lead("fingerprint").over(order))
    return met.where(~F.col("tail")).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"))
