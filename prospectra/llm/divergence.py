"""Source divergence audit by iceberg prefix refinement.

For every language, which sources differ from each other in the terms they
use, and which terms set a source apart from its language.  Only terms in at
least ``LEAST_DOCS`` documents of the language take part.

The frequent terms are found without ever counting the rare ones.  A term can
be in no more documents than any of its prefixes, so prefixes are counted level
by level (6 bytes, 12, 24, ...), and a prefix below the threshold is discarded
together with all terms below it.  Terms end in a mark, so a prefix that ends
in the mark is a complete term and is done; refinement ends when no longer
prefix is left.  Each document sends a prefix at most once per level and counts
are combined before they move, in runs of documents and then per task, so what
is shuffled per level is a few counts per kept prefix and task, even where one
language holds most documents.

Shares are exact integers: ``1 + floor(10**9 * (count + 5) / (N + 5 * V))``,
worked out by long division inside 64 bits.  Distances of sources need the
shares of terms that a source lacks too.  Terms are dealt into blocks and the
sources of a language into tiles; a task holds one block of two tiles as a
matrix of bounded size, and the blocks' distances are added up.

Defined results: NULL text, language and source are empty texts; a document
without terms still makes its group occur; a language without frequent terms
has distance 0 between its sources and no term rows; a language's only source
has no pair rows; repeated rows are documents of their own; ties of a value are
ranked by the item's UTF-8 bytes; an empty table gives an empty table.  Texts
of any length are read whole; only ``text``, ``lang`` and ``source`` are read,
so other columns cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospectra.llm.common import in_slices, ready_for_python, small_or_plain
from prospectra.session import write_and_read_back

LEAST_DOCS = 30
FIRST_WIDTH = 6
TOP_TERMS = 50
# A task's matrix: so many terms by twice so many sources at most.
BLOCK_TERMS = 2048
TILE_SOURCES = 128

# Terms of more characters stand in a column of their own too, which is all that wider prefixes read.
LONG = 12
# Terms of documents that a task combines at a time.
RUN_TERMS = 500_000

# Fixed values of the shares.
SCALE_STEPS, STEP = 3, 1000     # 10**9, in three long-division steps of 1000
ADDED = 5

_END = " "      # below every byte of a term
# Bytes of terms, A-Z in lower case; all others separate.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_TERMS = "lang string, source string, terms array<string>, counts array<int>"
# In the written table terms and counts are one value each: Spark moves them as a block, and Arrow splits them.
_PACKED = "lang string, source string, terms string, longer string, counts binary"
_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("terms", pa.string()), ("longer", pa.string()),
                    ("counts", pa.binary())])
_BREAK = "\n"    # in no term
_COUNT = np.dtype("<i8")


def _packed(terms: Collection[bytes]) -> str | None:
    """The terms, each closed by a blank, with one character per byte, so that cutting characters cuts bytes."""
    return (b" \n".join(terms) + b" ").decode("latin-1") if terms else None


def _count_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, 2):
        langs, sources, texts = (c.to_pylist() for c in batch.columns)
        terms, longer, counts = [], [], []
        for text in texts:
            found = Counter((text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split())
            terms.append(_packed(found))
            longer.append(_packed([t for t in found if len(t) >= LONG]))
            counts.append(np.fromiter(found.values(), _COUNT, len(found)).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([x or "" for x in langs], pa.string()), pa.array([x or "" for x in sources], pa.string()),
             pa.array(terms, pa.string()), pa.array(longer, pa.string()), pa.array(counts, pa.binary())], schema=_ARROW)


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """A written table of one row per document: its distinct terms, spelt one character per byte, closed by a
    blank and put together with line feeds (NULL without terms), the long ones once more, and how often each
    occurs, as 64-bit integers."""
    ready_for_python(docs)
    rows = docs.select(*[F.col(c).cast("string") for c in (lang, source, text)])
    return write_and_read_back(rows.mapInArrow(_count_terms, _PACKED), "audit-terms")


def _in_runs(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """The batches put together to about ``RUN_TERMS`` terms each, packed terms of ``column`` as lists; one batch at least."""
    held, size = [], 0
    for batch in batches:
        lists = batch.column(column)
        if not pa.types.is_list(lists.type):
            lists = pc.split_pattern(lists, _BREAK)
        held.append(batch.set_column(column, batch.schema.names[column], lists))
        size += pc.sum(pc.list_value_length(lists)).as_py() or 0
        if size >= RUN_TERMS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def _one_chunk(column: pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks()
    return found.chunk(0) if isinstance(found, pa.ChunkedArray) else found


def _count_prefixes(before: int, width: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents of a run per (lang, prefix of ``width`` bytes); terms of up to ``before`` bytes are complete already."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for documents in _in_runs(batches, 1):
            lists = _one_chunk(documents["terms"])
            at, terms = pc.list_parent_indices(lists), pc.list_flatten(lists)
            if before:
                longer = pc.greater(pc.utf8_length(terms), before)
                at, terms = at.filter(longer), terms.filter(longer)
            prefixes = pc.utf8_slice_codeunits(terms, 0, width)
            once = pa.table({"at": at, "term": prefixes}).group_by(["at", "term"], use_threads=False).aggregate([])
            counts = (pa.table({"lang": documents["lang"].take(once["at"]), "term": once["term"]})
                      .group_by(["lang", "term"], use_threads=False).aggregate([([], "count_all")]))
            yield from counts.select(["lang", "term", "count_all"]).rename_columns(["lang", "term", "docs"]).to_batches()
    return run


def _counts(column: pa.ChunkedArray) -> pa.Array:
    """All documents' counts, packed or as lists."""
    if pa.types.is_list(column.type):
        return pc.list_flatten(_one_chunk(column)).cast(pa.int64())
    return pa.array(np.frombuffer(b"".join(column.to_pylist()), _COUNT))


def _count_uses(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences in a run per (lang, source, term)."""
    for documents in _in_runs(batches, 2):
        lists = _one_chunk(documents["terms"])
        at = pc.list_parent_indices(lists)
        uses = pa.table({"lang": documents["lang"].take(at), "source": documents["source"].take(at), "term": pc.list_flatten(lists),
                         "n": _counts(documents["counts"])})
        counts = uses.group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum")])
        yield from counts.select(["lang", "source", "term", "n_sum"]).rename_columns(["lang", "source", "term", "n"]).to_batches()


def frequent_terms(documents: DataFrame, least_docs: int = LEAST_DOCS, first_width: int = FIRST_WIDTH) -> DataFrame:
    """(lang, term, docs): the terms in at least ``least_docs`` documents of a language, by refinement of prefixes."""
    before, width, kept, complete = 0, first_width, None, None
    while True:
        terms = F.col("longer" if before >= LONG else "terms")
        items = documents.where(terms.isNotNull()).select("lang", terms.alias("terms")).mapInArrow(_count_prefixes(before, width), "lang string, term string, docs long")
        if kept is not None:
            prefixes = small_or_plain(kept.select(F.col("lang").alias("_lang"), F.col("term").alias("_prefix")))
            items = items.join(prefixes, (F.col("lang") == F.col("_lang"))
                               & (F.substring("term", 1, before) == F.col("_prefix")), "left_semi")
        level = write_and_read_back(items.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))
                                    .where(F.col("docs") >= least_docs), "audit-prefixes")
        done = level.where(F.col("term").endswith(_END))
        complete = done if complete is None else complete.union(done)
        kept = level.where(~F.col("term").endswith(_END))
        if kept.isEmpty():
            return complete
        before, width = width, 2 * width


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (count + 5) / (total + 5 * terms)), exact: count is never above total."""
    whole = total + ADDED * terms
    # The table's own columns are bigint; remainders stay below the divisor, so nothing overflows below 9 * 10**15.
    rest, out = count + ADDED, F.lit(0).cast("long")
    for _ in range(SCALE_STEPS):
        out = out * STEP + F.call_function("div", rest * STEP, whole)
        rest = (rest * STEP) % whole
    return out + 1


def _spelt(term: Column) -> Column:
    """The term's own characters."""
    return F.decode(F.encode(F.rtrim(term), "ISO-8859-1"), "UTF-8")


_DISTANCES = "lang string, a int, b int, value long"
_DISTANCES_ARROW = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())])


def _block_distances(tile: int):
    def run(table: pa.Table) -> pa.Table:
        """Distances over one block's terms, of the sources of one tile from those of another, less what
        they would be if no source had a term: terms that neither tile has are not in the block.

        Rows without a term name a source and the share of terms it lacks.
        """
        term = table["term_id"].combine_chunks().dictionary_encode()
        at = term.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        place, p = (table[c].to_numpy() for c in ("place", "p"))
        bare = at < 0
        order = np.argsort(place[bare])
        places, absent = place[bare][order], p[bare][order]
        shares = np.repeat(absent[:, None], len(term.dictionary), axis=1)
        shares[np.searchsorted(places, place[~bare]), at[~bare]] = p[~bare]
        rows = np.flatnonzero(places // tile == table["tile_a"][0].as_py())
        columns = np.flatnonzero(places // tile == table["tile_b"][0].as_py())
        a, b, value = [], [], []
        for i in rows:
            later = columns[columns > i]
            a.append(np.repeat(places[i], len(later)))
            b.append(places[later])
            value.append((np.abs(shares[later] - shares[i]).sum(axis=1)
                          - len(term.dictionary) * np.abs(absent[later] - absent[i])))
        made = [pa.array(np.concatenate(x) if x else [], f.type) for x, f in zip((a, b, value), list(_DISTANCES_ARROW)[1:])]
        lang = pa.array([table["lang"][0].as_py()] * len(made[0]), pa.string())
        return pa.Table.from_arrays([lang, *made], schema=_DISTANCES_ARROW)
    return run


def _distances(shares: DataFrame, groups: DataFrame, block_terms: int, tile: int) -> DataFrame:
    """(lang, a, b, value) for places a < b of sources: shares' distances summed over all kept terms,
    less the distance of two sources that have none."""
    blocks = F.greatest(F.ceil(F.col("v") / block_terms), F.lit(1)).cast("int")
    tiles = F.ceil(F.col("sources") / tile).cast("int")
    own = F.floor(F.col("place") / tile).cast("int")
    # A tile meets every tile once, itself too; a language whose sources fit one tile repeats nothing.
    meets = F.transform(F.sequence(F.lit(0), tiles - 1), lambda t: F.struct(
        F.least(own, t).alias("tile_a"), F.greatest(own, t).alias("tile_b")))
    columns = ["lang", "block", "tile_a", "tile_b", "place", "term_id", "p"]
    bare = (groups.where("v > 0").select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
            .select("*", F.inline(meets)).withColumns({"term_id": F.lit(None).cast("long"), "p": F.col("absent")}))
    held = shares.withColumn("block", F.pmod(F.col("term_id"), blocks).cast("int")).select("*", F.inline(meets))
    return (held.select(*columns).unionByName(bare.select(*columns)).groupBy("lang", "block", "tile_a", "tile_b")
            .applyInArrow(_block_distances(tile), _DISTANCES).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, text: str = "text",
          lang: str = "lang", source: str = "source", first_width: int = FIRST_WIDTH, block_terms: int = BLOCK_TERMS,
          tile_sources: int = TILE_SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): per source its distance from every other source of
    the language (``pair``), and the terms it uses more than its language does (``term``)."""
    documents = count_terms(docs, text, lang, source)
    every = write_and_read_back(documents.select("lang", "source").distinct()
                                .withColumn("group_id", F.monotonically_increasing_id()), "audit-sources")
    # Numbered in the order of languages and terms, so that numbers stand in for terms until the end.
    kept = write_and_read_back(
        frequent_terms(documents, least_docs, first_width).select("lang", "term").repartitionByRange("lang", "term")
        .sortWithinPartitions("lang", "term").withColumn("term_id", F.monotonically_increasing_id()), "audit-kept")
    wanted = small_or_plain(kept.select(F.col("lang").alias("_lang"), F.col("term").alias("_term"), "term_id"))
    uses = documents.mapInArrow(_count_uses, "lang string, source string, term string, n long")
    counts = write_and_read_back(
        uses.join(small_or_plain(every), ["lang", "source"]).select("lang", "group_id", "term", "n").join(wanted, (F.col("lang") == F.col("_lang")) & (F.col("term") == F.col("_term")))
        .groupBy("group_id", "term_id").agg(F.sum("n").alias("n")), "audit-counts")

    totals = counts.groupBy("group_id").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    in_lang = Window.partitionBy("lang")
    groups = write_and_read_back(
        every.join(totals, "group_id", "left").join(sizes, "lang", "left")
        .select("lang", "source", "group_id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
        .select("*", F.sum("total").over(in_lang).alias("lang_total"), F.count("*").over(in_lang).alias("sources"),
                (F.row_number().over(in_lang.orderBy("source")) - 1).alias("place"))
        .withColumn("absent", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("v")))),
        "audit-groups")
    shares = counts.join(small_or_plain(groups), "group_id").withColumn(
        "p", share(F.col("n"), F.col("total"), F.col("v")))

    values = _distances(shares, groups, block_terms, tile_sources)
    both = values.select("lang", "value", F.inline(F.array(
        *[F.struct(F.col(x).alias("place"), F.col(y).alias("other")) for x, y in ("ab", "ba")])))
    one = groups.select("lang", "source", "place", "v", "absent")
    other = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("other"), F.col("absent").alias("lacks"))
    without = F.coalesce(F.col("v") * F.abs(F.col("absent") - F.col("lacks")), F.lit(0))
    # The result has a row for every two sources of a language; their number is its size.
    pairs = (one.join(other, "lang").where("place <> other").join(both, ["lang", "place", "other"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("value", F.lit(0)) + without).alias("value")))
    ranked = pairs.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    overall = counts.groupBy("term_id").agg(F.sum("n").alias("lang_n"))
    above = (shares.join(overall, "term_id")
             .withColumn("value", F.col("p") - share(F.col("lang_n"), F.col("lang_total"), F.col("v"))).where("value > 0"))
    by_value = Window.partitionBy("group_id").orderBy(F.desc("value"), "term_id")
    best = above.select("lang", "source", "group_id", "term_id", "value", F.row_number().over(by_value).alias("rank"))
    terms = (best.where(F.col("rank") <= top_terms).join(kept.select("term_id", "term"), "term_id")
             .select("lang", "source", F.lit("term").alias("part"), _spelt(F.col("term")).alias("item"), "value", "rank"))
    return ranked.unionByName(terms)
