"""Byte strings that occur more than once, by longest-previous-factor arrays.

A suffix begins at each byte that has `length` bytes from there on in its document. Its anchor is the place of the smallest hash of GRAM bytes within those
`length` bytes, which equal strings share; neighbouring suffixes mostly have one anchor and make a stretch. Stretches meet by their anchor's hash, as
light rows without text: an anchor that occurs once has no repeat; stretches whose whole text occurs again (128 bits of two hashes) are settled
at once, and one of each is enough for what is left. Only the different texts under one anchor are looked at byte by byte: a task puts their
suffixes into suffix order, ties by place, and reads off the longest-previous-factor array where it reaches `length`: the previous smaller place in suffix order is
then the neighbour before, and the next smaller one shares less. The neighbour behind tells what a first copy is repeated by.

Every task first joins equal stretches of its own, so a passage in a third of all documents is one row a task. An anchor with more than HOT different stretches is
not gathered: its prefix is lengthened to the whole string, whose hashes are counted by partial sums.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.folders import work_folder, written
from tessera.llm import words
from tessera.llm.common import binary_array, binary_parts, chunks, long_array, released, text_bytes

#: Bytes of an anchor at most; bytes of text that are hashed at once, and whose stretches a task joins before it ships them.
GRAM, PIECE, JOINED = 200, 1 << 20, 32 << 20
#: Different stretches under one anchor that are still gathered; suffixes and bytes that a task orders at once.
HOT, ORDERED, ORDERED_BYTES = 256, 100_000, 4 << 20
#: Places in a packet; the longest `length`.
PACKET, LONGEST = 1024, 1 << 16
NO_ID = -(2**63)
STRETCH = "gram long, digest long, id long, sum long, first long, n long, copies long, more binary"
SETTLED = "gram long, id long, sum long, first long, n long, hot boolean"
BODY = "gram long, other long, id long, sum long, first long, n long, body binary"
MARK = "id long, sum long, first long, n long"


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


@functools.cache
def _tables(second: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of bytes, powers of a base and of its inverse."""
    codes, base = words.BYTE_CODES, words.BASE
    if second:
        codes, base = words.mix(codes), words.mix(np.array([base]))[0] | np.uint64(1)
    return codes, words.powers(PIECE + (1 << 16), base), words.powers(PIECE + (1 << 16), np.uint64(_inverse(int(base))))


class Hashes:
    """Hashes of any stretch of bytes, from sums that run along them."""

    def __init__(self, data: np.ndarray, second: bool = False):
        codes, powers, self.back = _tables(second)
        self.upto = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * powers[: len(data)], dtype=np.uint64, out=self.upto[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return words.mix((self.upto[end] - self.upto[begin]) * self.back[begin])

    def all(self, size: int) -> np.ndarray:
        """Of the size bytes from each place on."""
        n = len(self.upto) - size
        return words.mix((self.upto[size:] - self.upto[:n]) * self.back[:n])


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of the size values from each place on, by running minima of blocks of that size."""
    n = len(values)
    blocks = np.append(values, np.full(-n % size, values.max(), values.dtype)).reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - size + 1], ahead[size - 1 : n])


def stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """First suffix, number of suffixes, hash of the anchor and hash of the whole text of each stretch. At most PIECE + length bytes, texts end to end."""
    own = np.diff(offsets) >= length
    begins, ends = offsets[:-1][own], offsets[1:][own] - length + 1  # of suffixes
    if not len(begins):
        return (np.zeros(0, np.int64),) * 4
    size, low = min(GRAM, length), np.uint64((1 << 24) - 1)
    grams = Hashes(data).all(size)
    place = (sliding_least(grams & ~low | np.arange(len(grams), dtype=np.uint64), length - size + 1) & low).astype(np.int64)  # the first one on ties
    depth = np.zeros(len(place) + 1, np.int8)
    np.add.at(depth, begins, 1)
    np.add.at(depth, ends, -1)
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    new[begins] = True
    first = np.flatnonzero(new & (np.cumsum(depth[:-1], dtype=np.int8) > 0))
    last = np.minimum(np.append(first[1:], len(place)), ends[np.searchsorted(ends, first, "right")])
    whole = Hashes(data, second=True)(first, last + length - 1)
    return first, last - first, grams[place[first]], words.mix(whole + words.mix((place[first] - first).astype(np.uint64) << np.uint64(20) | (last - first).astype(np.uint64)))


def units(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Texts of a chunk, their offsets and the bytes before; a longer text comes in pieces, so that each suffix is in one of them."""
    if len(part) == 1 and len(data) > PIECE:
        for at in range(0, len(data) - length + 1, PIECE):
            piece = data[at : at + PIECE + length - 1]
            yield piece, np.array([0, len(piece)]), at
    else:
        yield data, offsets, 0


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns]


def _ship(length: int, first_stays: bool):
    """Stretches; of equal ones in a task the first, and packets of the others' places, which are marks already and only pass through."""
    names = [x.split()[0] for x in STRETCH.split(", ")]

    def joined(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        gram, digest, ids, sums, first, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((first, sums, ids, digest, gram))
        gram, digest, ids, sums, first, n = (x[order] for x in (gram, digest, ids, sums, first, n))
        lead = _new(gram, digest)
        at = np.flatnonzero(lead)
        copies = np.diff(np.append(at, len(gram)))
        yield pa.RecordBatch.from_arrays([*_longs(*(x[at] for x in (gram, digest, ids, sums, first, n)), copies), pa.nulls(len(at), pa.binary())], names=names)
        again = ~lead & _new(gram, digest, ids, sums, first) if first_stays else ~lead  # one place twice is no copy of itself
        rest = np.stack([x[again] for x in (ids, sums, first, n)], axis=1)
        upto = np.append(np.arange(0, len(rest), PACKET), len(rest))
        if len(rest):
            key = gram[again][upto[:-1]] ^ words.mix(rest[upto[:-1], 0].view(np.uint64))  # packets go anywhere
            none = np.zeros(len(key), np.int64)
            yield pa.RecordBatch.from_arrays([*_longs(key, *[none] * 6), binary_array(rest.view(np.uint8).ravel(), upto * rest.itemsize * 4)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for part, whole, all_offsets in chunks(batch, "raw", PIECE):
                ids, sums = long_array(part.column(0)), long_array(part.column(1))
                for data, offsets, base in units(part, whole, all_offsets, length):
                    first, n, gram, digest = stretches(data, offsets, length)
                    if len(first):
                        doc = np.searchsorted(offsets, first, "right") - 1
                        parts.append((gram, digest, ids[doc], sums[doc], first - offsets[doc] + base, n))
                    held += len(data)
                    if held >= JOINED and parts:
                        yield from joined(parts)
                        parts, held = [], 0
        if parts:
            yield from joined(parts)

    return lambda batches: released(run(batches))


def _settle(first_stays: bool, hot: int):
    """Of stretches sorted by anchor and text: marks of those that occur again (without gram), and one of each text whose anchor has other texts."""

    names = [x.split()[0] for x in SETTLED.split(", ")]

    def settled(table: pa.Table) -> Iterator[pa.RecordBatch]:
        gram, digest, ids, sums, first, n, count = (table[i].to_numpy() for i in range(7))
        owner = np.cumsum(_new(gram, digest)) - 1  # the number of each row's text
        order = np.lexsort((first, sums, ids, owner))
        gram, owner, ids, sums, first, n, count = (x[order] for x in (gram, owner, ids, sums, first, n, count))
        begin = _new(owner)
        lead = np.flatnonzero(begin)
        place = np.cumsum(_new(owner, ids, sums, first))  # rows of one place count as one
        least = place == np.repeat(place[lead], np.diff(np.append(lead, len(owner))))
        mark = ~least if first_stays else np.add.reduceat(count, lead)[owner] > 1
        start = np.flatnonzero(_new(gram[lead]))
        variants = np.diff(np.append(start, len(lead)))
        variants = np.repeat(variants, variants)[owner]
        item = begin & (variants > 1)
        for take, named in ((mark, False), (item, True)):
            if k := int(take.sum()):
                key, common = (pa.array(gram[take]), pa.array(variants[take] > hot)) if named else (pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()))
                yield pa.RecordBatch.from_arrays([key, *_longs(ids[take], sums[take], first[take], n[take]), common], names=names)

    def passed(more: pa.Array) -> Iterator[pa.RecordBatch]:
        rows = binary_parts(more)[0].view(np.int64).reshape(-1, 4)
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), *_longs(*rows.T), pa.nulls(len(rows), pa.bool_())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            packet = batch.column(7).is_valid()
            yield from passed(batch.column(7).filter(packet))
            batch = batch.filter(pc.invert(packet))
            if not batch.num_rows:
                continue
            gram = batch.column(0).to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))  # the last anchor may go on
            if cut or held and held[-1].column(0)[-1].as_py() != gram[0]:
                yield from settled(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks())
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from settled(pa.Table.from_batches(held).combine_chunks())

    return lambda batches: released(run(batches))


def _bodies(length: int):
    """The bytes of stretches; of those under a hot anchor, the hashes of each string."""
    names = [x.split()[0] for x in BODY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "raw", PIECE):
                items = part.column(3)
                flat = items.flatten()
                gram, first, n, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                row = np.repeat(np.arange(len(part)), items.value_lengths().to_numpy())
                ids, sums = long_array(part.column(0))[row], long_array(part.column(1))[row]
                begin = offsets[row] + first
                size = n + length - 1
                cold = np.flatnonzero(~hot)
                for some in np.array_split(cold, max(1, int(size[cold].sum()) >> 24)):
                    if len(some):
                        upto = np.append(0, np.cumsum(size[some]))
                        step = np.arange(int(upto[-1])) - np.repeat(upto[:-1], size[some])
                        body = binary_array(data[np.repeat(begin[some], size[some]) + step], upto)
                        yield pa.RecordBatch.from_arrays([*_longs(gram[some]), pa.nulls(len(some), pa.int64()), *_longs(ids[some], sums[some], first[some], n[some]), body], names=names)
                for i in np.flatnonzero(hot).tolist():
                    text = data[begin[i] : begin[i] + size[i]]
                    one, other = Hashes(text).all(length), Hashes(text, second=True).all(length)
                    k = len(one)
                    yield pa.RecordBatch.from_arrays([*_longs(one, other, np.full(k, ids[i]), np.full(k, sums[i]), first[i] + np.arange(k), np.ones(k, np.int64)), pa.nulls(k, pa.binary())], names=names)

    return lambda batches: released(run(batches))


def neighbours(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes given in order of their places: the nearest earlier and later one that shares `length` bytes, or -1.

    Suffixes with a twin by hash are sorted by their bytes, ties by place. Where the longest previous factor reaches `length`, the previous smaller place
    in that order is the neighbour before.
    """
    before, behind = np.full(len(at), -1), np.full(len(at), -1)
    h = np.concatenate([Hashes(data[i : i + PIECE + length - 1]).all(length) for i in range(0, len(data) - length + 1, PIECE)])[at]
    by = np.argsort(h, kind="stable")
    twin = h[by][1:] == h[by][:-1]
    own = np.sort(by[np.append(twin, False) | np.append(False, twin)])
    if len(own):
        keys = np.ndarray(len(data) - length + 1, f"S{length}", np.ascontiguousarray(data), 0, (1,))[at[own]]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        same = keys[1:] == keys[:-1]
        own = own[order]
        before[own[1:][same]], behind[own[:-1][same]] = own[:-1][same], own[1:][same]
    return before, behind


def _factors(length: int, first_stays: bool):
    """Marks of suffixes that share `length` bytes with another under the same anchor; stretches come sorted by anchor."""

    def marks(gram, ids, sums, first, n, bodies, offsets) -> Iterator[pa.RecordBatch]:
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at, ids, sums, place = offsets[:-1][row] + step, ids[row], sums[row], first[row] + step
        order = np.lexsort((place, sums, ids))
        before, behind = neighbours(bodies, at[order], length)
        hit = np.sort(order[(before >= 0) if first_stays else (before >= 0) | (behind >= 0)])
        if len(hit):
            ids, sums, place = ids[hit], sums[hit], place[hit]
            new = _new(ids, sums, place - np.arange(len(place)))
            lead = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays(_longs(ids[lead], sums[lead], place[lead], np.diff(np.append(lead, len(hit)))), names=[x.split()[0] for x in MARK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts).combine_chunks()
            gram = table["gram"].to_numpy()
            columns = [table[c].to_numpy() for c in ("gram", "id", "sum", "first", "n")]
            data, offsets = binary_parts(table["body"].combine_chunks())
            starts = np.flatnonzero(_new(gram))
            upto, begin = np.append(0, np.cumsum(columns[4])), 0
            for end in [*starts[1:].tolist(), len(gram)]:  # whole anchors, until there is enough to order
                if end == len(gram) or upto[end] - upto[begin] >= ORDERED or offsets[end] - offsets[begin] >= ORDERED_BYTES:
                    yield from marks(*(c[begin:end] for c in columns), data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin])
                    begin = end

        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column(0).to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))
            if held and (cut or held[-1].column(0)[-1].as_py() != gram[0]) and sum(x.nbytes for x in held) >= ORDERED_BYTES:
                yield from flush([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                held.append(batch.slice(0, cut))
            held.append(batch.slice(cut))
        if held:
            yield from flush(held)

    return lambda batches: released(run(batches))


def _merged(first: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of bytes that marks cover."""
    order = np.argsort(first, kind="stable")
    begin, end = first[order], np.maximum.accumulate((first + n + length - 1)[order]) if len(first) else first
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    lead = np.flatnonzero(new)
    return begin[lead], end[np.append(lead[1:], len(begin)) - 1] if len(lead) else end


def _kept(length: int, with_text: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "raw"):
                lists = part.column(2)
                flat, upto = lists.flatten(), np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
                first, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
                out: list[tuple] = []
                for i in range(len(part)):
                    text = data[offsets[i] : offsets[i + 1]]
                    begin, end = _merged(first[upto[i] : upto[i + 1]], n[upto[i] : upto[i + 1]], length)
                    digest, kept = hashlib.sha256(), []
                    for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(text)], strict=True):
                        digest.update(text[a:b])
                        if with_text:
                            kept.append(text[a:b].tobytes())
                    out.append((len(text), int((end - begin).sum()), len(begin), digest.hexdigest(), b"".join(kept)))
                columns = list(zip(*out, strict=True))[: 4 + with_text]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, k) for c, k in zip(columns[3:], (pa.string(), pa.binary())[: 1 + with_text], strict=True))], names=names)

    return lambda batches: released(run(batches))


def _texts(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, id and sum that name a text, and its bytes."""
    raw = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("raw"))
    return raw.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("raw").alias("sum"), "raw")


def _marks(texts: DataFrame, length: int, first_stays: bool, hot: int) -> DataFrame:
    """id, sum and marks, an array of (first, n): runs of suffixes whose first `length` bytes occur elsewhere, or, if first copies stay, earlier."""
    spark, folder = texts.sparkSession, work_folder(texts.sparkSession, "factors")
    if not 1 <= length <= LONGEST:
        raise ValueError(f"length must be 1 to {LONGEST}")
    met = texts.select("id", "sum", "raw").mapInArrow(_ship(length, first_stays), STRETCH).repartition("gram").sortWithinPartitions("gram", "digest")
    settled = written(met.mapInArrow(_settle(first_stays, hot), SETTLED), f"{folder}/settled")
    items = settled.where("gram IS NOT NULL").groupBy("id", "sum").agg(F.collect_list(F.struct("gram", "first", "n", "hot")).alias("items"))  # stretches of one text
    items = written(items, f"{folder}/items")
    asked = texts.select("id", "sum", "raw").dropDuplicates(["id", "sum"]) if first_stays else texts.select("id", "sum", "raw")
    found = asked.join(items.hint("merge"), ["id", "sum"]).select("id", "sum", "raw", "items")
    bodies = written(found.mapInArrow(_bodies(length), BODY), f"{folder}/bodies")
    near = bodies.where("body IS NOT NULL").select("gram", "id", "sum", "first", "n", "body").repartition("gram").sortWithinPartitions("gram")
    marks = settled.where("gram IS NULL").select("id", "sum", "first", "n").union(near.mapInArrow(_factors(length, first_stays), MARK))
    strings = bodies.where("body IS NULL").select("gram", "other", "id", "sum", "first", "n")
    place = F.struct("id", "sum", "first")
    counted = written(strings.groupBy("gram", "other").agg(F.count("*").alias("copies"), F.min(place).alias("least")).where("copies > 1"), f"{folder}/strings")
    again = strings.join(counted.hint("merge"), ["gram", "other"]).where(place > F.col("least") if first_stays else F.lit(True))
    marks = marks.union(again.select("id", "sum", "first", "n")).groupBy("id", "sum").agg(F.collect_list(F.struct("first", "n")).alias("marks"))  # of one text
    return written(marks, f"{folder}/marks")


def repeated_spans(docs: DataFrame, length: int = 400, first_stays: bool = True, hot: int = HOT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start, n_bytes of the maximal spans that repeat (see remove_repeated_bytes). Rows that share doc_id and text give their spans once."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                flat = batch.column(1)[i].values
                begin, end = _merged(*(flat.field(j).to_numpy(zero_copy_only=False) for j in range(2)), length)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(begin), pa.int64()), *_longs(begin, end - begin)], names=["doc_id", "start", "n_bytes"])

    marks = _marks(_texts(docs, text, doc_id), length, first_stays, hot)
    return marks.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "marks").mapInArrow(merge, "doc_id long, start long, n_bytes long")


def remove_repeated_bytes(docs: DataFrame, length: int = 400, first_stays: bool = True, with_text: bool = False, hot: int = HOT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (bytes).

    A text counts as UTF-8 bytes (null: none). A byte goes if a string of `length` bytes covers it that also starts earlier (by doc_id, those without one first, then by
    a hash of the text, then by place) or, with first_stays=False, anywhere else, the same document included; overlaps count, and matches stay within documents. Rows that share
    doc_id and text are copies of each other with first_stays=False; else they are one text, and all stay or lose the same. Shorter texts than `length` stay whole. An empty
    table gives no rows. Other columns of docs are not looked at. Whole stretches and strings under hot anchors are equal by 128 bits of two hashes, others by their bytes.
    """
    texts = _texts(docs, text, doc_id)
    joined = texts.join(_marks(texts, length, first_stays, hot).hint("merge"), ["id", "sum"], "left").select("doc_id", "raw", "marks")
    return joined.mapInArrow(_kept(length, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
