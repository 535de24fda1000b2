"""How the terms of sources differ, by joint histograms of their counts.

Terms are counted by language and source in one pass over the texts. Two sources of a language are compared through a joint histogram: how many terms have which pair of counts.
Tasks tally the pairs of counts of terms that both have, and send each combination once with its multiplicity; the cells where one or both have no occurrence are implied by the
histograms of single sources and by the number of terms. The difference is then evaluated once for each combination and multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.folders import work_folder, written
from tessera.llm import words
from tessera.llm.common import CHUNK_BYTES, chunks, long_array, released, text_bytes

#: Shares are counted in parts of ONE; SMOOTH occurrences are added to each term.
ONE, SMOOTH = 10**9, 5
#: Pairs of cells that a task tallies at once, and combinations that it holds.
PAIRS, HELD = 1 << 20, 1 << 21
COUNTED = "lang string, source string, term string, n long, docs long"
TALLY = "a long, b long, ca long, cb long, m long"
#: Bytes of terms: letters, and all of characters beyond ASCII.
IN_TERM = np.zeros(256, bool)
IN_TERM[65:91] = IN_TERM[97:123] = IN_TERM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts laid end to end, A-Z lowered, and the text of each."""
    solid = IN_TERM[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = offsets[:-1][np.diff(offsets) > 0]
    first[begins] = solid[begins]
    starts = np.flatnonzero(first)
    upto = np.append((np.cumsum(solid) - 1)[starts], int(solid.sum())).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(upto), pa.py_buffer(LOWER[data[solid]])]), np.searchsorted(offsets, starts, "right") - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(groups: pa.Table, code: np.ndarray, terms: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        own = groups.take(pa.array(code))
        return pa.RecordBatch.from_arrays([*(own[c].combine_chunks() for c in ("lang", "source")), terms.cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "raw"):
                groups = pa.table({"lang": part.column(0), "source": part.column(1)})
                if len(part) == 1 and len(data) > CHUNK_BYTES:  # by pieces that end between terms; one document
                    found = []
                    for piece, _ in words.pieces(data, CHUNK_BYTES):
                        seen = terms_of(piece, np.array([0, len(piece)]))[0].value_counts()
                        found.append(pa.table({"term": seen.field(0), "n": seen.field(1)}))
                    total = pa.concat_tables(found).group_by("term").aggregate([("n", "sum")])
                    yield out(groups, np.zeros(len(total), np.int64), total["term"].combine_chunks(), total["n_sum"].to_numpy(), np.ones(len(total), np.int64))
                    continue
                terms, doc = terms_of(data, offsets)
                if not len(terms):
                    continue
                coded = terms.dictionary_encode()
                term, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
                lang, source = (part.column(i).dictionary_encode() for i in (0, 1))
                pair = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
                _, lead, group = np.unique(pair, return_index=True, return_inverse=True)
                own, times = np.unique(doc * size + term, return_counts=True)  # a document's terms
                (keys,), n, docs = combined([group[own // size] * size + own % size], times, rows=True)
                yield out(groups, lead[keys // size], coded.dictionary.take(pa.array(keys % size)), n, docs)

    return released(run())


def combined(columns: list[np.ndarray], m: np.ndarray | None, rows: bool = False) -> tuple:
    """Each combination of columns once, and the sum of its multiplicities (one each, if not given); with rows, also how many rows it had."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    lead = np.flatnonzero(new)
    many = np.diff(np.append(lead, len(order)))
    found = [c[lead] for c in columns], np.add.reduceat(m[order], lead) if m is not None else many
    return (*found, many) if rows else found


def tallied(term: np.ndarray, group: np.ndarray, n: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Of cells sorted by term and group: the combinations (a, b, count of a, count of b) of groups a < b that have a term in common, by stretches of pairs."""
    end = np.searchsorted(term, term, "right")
    partners = end - np.arange(len(term)) - 1
    upto = np.append(0, np.cumsum(partners))
    begin = 0
    while begin < len(term):
        stop = max(begin + 1, int(np.searchsorted(upto, upto[begin] + PAIRS, "right")) - 1)
        count = partners[begin:stop]
        if count.sum():
            one = np.repeat(np.arange(begin, stop), count)
            other = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(count) - count, count)
            yield combined([group[one], group[other], n[one], n[other]], None)
        begin = stop


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[list[np.ndarray], np.ndarray]] = []

    def joined() -> tuple[list[np.ndarray], np.ndarray]:
        return combined([np.concatenate(c) for c in zip(*(x for x, _ in held), strict=True)], np.concatenate([m for _, m in held]))

    def out(found: tuple[list[np.ndarray], np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (*found[0], found[1])], names=["a", "b", "ca", "cb", "m"])

    def add(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for found in tallied(*rows):
            held.append(found)
            if sum(len(m) for _, m in held) > HELD:
                held[:] = [joined()]
                if len(held[0][1]) > HELD // 2:
                    yield out(held.pop())

    def run() -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            rows = [np.append(r, long_array(batch.column(i))) for i, r in enumerate(rest)]
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0  # the last term may go on
            yield from add([r[:cut] for r in rows])
            rest = [r[cut:] for r in rows]
        yield from add(rest)
        if held:
            yield out(joined())

    return released(run())


def _div(x: Column, by: Column) -> Column:
    return F.call_function("div", x, by)


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(ONE * (n + SMOOTH) / (total + SMOOTH * terms)), exactly: three digits at a time, so that nothing overflows below 9 * 10^15 occurrences."""
    rest, by, out = n + SMOOTH, total + SMOOTH * terms, F.lit(0).cast("long")
    for _ in range(3):
        out, rest = out * 1000 + _div(rest * 1000, by), (rest * 1000) % by
    return out + 1


def divergence(docs: DataFrame, least_docs: int = 30, top: int = 50, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source): how it differs from other sources (part `pair`), and its most typical terms (part `term`).

    Null text, language and source count as ''. Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lowered; a language keeps those that are in at least `least_docs` of its
    rows. A term's share in a source or language is smoothed and whole (see share). `pair`: for each other source of the language the sum of |difference of shares| over all kept terms, 0
    without any. `term`: kept terms that the source has and whose share is above that of the language, with the difference, up to rank `top`. Ranks go by value, descending, then by item in
    UTF-8. A source without terms counts as having each 0 times; a language with one source has no pairs; an empty table gives no rows. Repeated rows count each. Other columns are not looked at.
    """
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession, "divergence")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = docs.select(name(lang).alias("lang"), name(source).alias("source"), text_bytes(text).alias("raw"))
    counts = written(own.mapInArrow(_count, COUNTED).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), f"{folder}/counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("of_lang")).where(F.col("docs") >= least_docs)
    terms = written(terms.select("lang", "term", "of_lang", F.monotonically_increasing_id().alias("tid")), f"{folder}/terms")
    cells = written(counts.select("lang", "term", "source", "n").join(terms, ["lang", "term"]), f"{folder}/cells")

    of_lang = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("of_lang").alias("lang_total"))
    of_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = own.select("lang", "source").distinct().join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").na.fill(0, ["v", "lang_total", "total"])
    groups = written(every.withColumn("g", F.monotonically_increasing_id()), f"{folder}/groups")
    cells = cells.join(groups, ["lang", "source"])

    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("of_lang"), F.col("lang_total"), F.col("v"))
    best = cells.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    side = lambda s: groups.select("lang", *(F.col(c).alias(f"{s}_{c}") for c in ("g", "source", "total")))
    pairs = written(groups.select("lang", "v", F.col("g").alias("a_g"), F.col("source").alias("a_source"), F.col("total").alias("a_total")).join(side("b"), "lang").where("a_g < b_g"), f"{folder}/pairs")
    met = cells.select("tid", "g", "n").repartition("tid").sortWithinPartitions("tid", "g").mapInArrow(_tally, TALLY).groupBy("a", "b", "ca", "cb").agg(F.sum("m").alias("m"))
    single = cells.groupBy("g", "n").agg(F.count("*").alias("m"))
    zero, row = F.lit(0).cast("long"), lambda ca, cb, m: F.struct(ca.alias("ca"), cb.alias("cb"), m.alias("m"))
    m, ca, cb, n = F.col("m"), F.col("ca"), F.col("cb"), F.col("n")
    parts = [
        met.select("a", "b", F.inline(F.array(row(ca, cb, m), row(ca, zero, -m), row(zero, cb, -m), row(zero, zero, m)))),
        pairs.join(single, F.col("a_g") == F.col("g")).select(F.col("a_g").alias("a"), F.col("b_g").alias("b"), F.inline(F.array(row(n, zero, m), row(zero, zero, -m)))),
        pairs.join(single, F.col("b_g") == F.col("g")).select(F.col("a_g").alias("a"), F.col("b_g").alias("b"), F.inline(F.array(row(zero, n, m), row(zero, zero, -m)))),
        pairs.select(F.col("a_g").alias("a"), F.col("b_g").alias("b"), zero.alias("ca"), zero.alias("cb"), F.col("v").alias("m")),
    ]
    joint = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).groupBy("a", "b", "ca", "cb").agg(F.sum("m").alias("m")).where("m > 0")
    told = joint.join(pairs.select(F.col("a_g").alias("a"), F.col("b_g").alias("b"), "v", "a_total", "b_total"), ["a", "b"])
    apart = F.abs(share(ca, F.col("a_total"), F.col("v")) - share(cb, F.col("b_total"), F.col("v")))
    sums = told.groupBy("a", "b").agg(F.sum(apart * m).alias("value"))
    valued = written(pairs.join(sums, (F.col("a") == F.col("a_g")) & (F.col("b") == F.col("b_g")), "left").select("lang", "a_source", "b_source", F.coalesce("value", zero).alias("value")), f"{folder}/values")
    both = F.inline(F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item"))))
    others = valued.select("lang", "value", both).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return others.union(best.select(others.columns))
