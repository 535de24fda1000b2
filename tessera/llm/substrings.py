"""Passages that documents share, by prefix-partitioned suffix trees.

A suffix begins at each word that has `window` words from there on in its document; trees are cut at that depth. Suffixes are split into groups that
fit into memory by variable-length prefixes of a path. The path of a suffix is not its first words but its landmark (of the window's 3-word
hashes the smallest, which equal windows share) and then the rest of the window: neighbouring suffixes mostly have the same landmark, so they go
to a group together, as one stretch of text, three words a suffix instead of thirteen. A count over the whole corpus tells which landmark
prefixes fit together into a group, which need more of the landmark's bits, and which hold so common a landmark that the prefix is lengthened to
the whole window; those suffixes go one by one.

A task builds the tree of a group on the words themselves: they get ranks, told apart by their bytes; suffixes that may have a twin are
sorted by the ranks of their words, and neighbours that share `window` words hang from one internal node. A node with leaves of several
documents is a repeat; repeats next to each other make the maximal ones. No hash decides: hashes only bring together what may be equal. A
group that is too large to be sorted at once, because the corpus is large or one window is in very many documents, is met in two steps: its blobs are dealt into slots by
chunk, where of each window only the suffix of the smallest document stays, and what stays goes on to finer groups, by longer prefixes.

Within a chunk of text the same trees tell which suffixes have an equal one in a smaller document; only the others are shipped, so that a passage
which is in a third of all documents comes to a group once a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.folders import work_folder, written
from tessera.llm import words
from tessera.llm.common import CHUNK_BYTES, chunks, long_array, released, text_bytes

LANDMARK = 3
#: Fewest and most cells of landmark hashes that are counted, and how many there are for each group.
CELLS, MOST_CELLS, CELLS_EACH = 1 << 12, 1 << 20, 16
#: Cells in one row of counts.
SLICE = 1 << 12
#: Suffixes that a task sorts at once, and groups for each shuffle partition.
GROUP_WINDOWS, GROUPS_EACH = 600_000, 8
#: A cell with more than this many times both a group's share and the mean of cells holds a common landmark.
COMMON = 2
#: Bytes that are compared at once.
COMPARED = 1 << 20
NONE, ONE = np.zeros(0, np.int64), np.ones(1, np.int64)
MARK_TYPE = "doc_id long, sum long, first long, n long"


def landmarks(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For the window at each word: its smallest hash of LANDMARK words, and where that begins in it. The last window - 1 are of no use."""
    size = min(LANDMARK, window)
    g = words.grams(h, size)
    least, where = g.copy(), np.zeros(len(g), np.uint8)
    for j in range(1, window - size + 1):
        ahead, upto = g[j:], least[: len(g) - j]
        lower = ahead < upto
        upto[lower], where[: len(g) - j][lower] = ahead[lower], j
    return least, where


def suffixes(before: np.ndarray, order: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each suffix, by the documents in order: document and place in all words."""
    per_doc = np.maximum(np.diff(before) - window + 1, 0)[order]
    docs = np.repeat(order, per_doc)
    return docs, before[:-1][docs] + np.arange(len(docs)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)


def ranks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, used: np.ndarray) -> np.ndarray:
    """A number for each word in the places used, the same for the same bytes only; other places have 0."""
    out = np.zeros(len(h), np.int64)
    _, first, inverse = np.unique(h[used], return_index=True, return_inverse=True)
    one, length = used[first][inverse], (ends - starts).astype(np.int32)
    same = length[used] == length[one]
    upto = np.cumsum(length[used], dtype=np.int64)
    cuts = [0, *np.searchsorted(upto, np.arange(COMPARED, int(upto[-1]), COMPARED)).tolist(), len(used)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        mine, other = used[a:b][same[a:b]], one[a:b][same[a:b]]
        n = length[mine]
        if len(n):
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            equal = data[np.repeat(starts[mine], n) + step] == data[np.repeat(starts[other], n) + step]
            same[a:b][same[a:b]] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    out[used] = inverse
    if not same.all():  # words that differ and have one hash: by their bytes
        names: dict[bytes, int] = {}
        out[used] = [names.setdefault(data[s:e].tobytes(), len(names)) for s, e in zip(starts[used].tolist(), ends[used].tolist(), strict=True)]
    return out


def tree(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The internal nodes of depth window in the tree of the suffixes that begin at the words `at`: suffixes, each node's next to each other,
    and the places where nodes begin. Suffixes without a twin are left out."""
    full = words.grams(h, window)[at]
    by = np.argsort(full, kind="stable")
    full = full[by]
    twin = full[1:] == full[:-1]
    own = np.sort(by[np.append(twin, False) | np.append(False, twin)])
    del full, by
    if not len(own):
        return NONE, NONE
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, at[own], 1)
    np.add.at(cover, at[own] + window, -1)
    rank = ranks(data, starts, ends, h, np.flatnonzero(np.cumsum(cover)[:-1]))
    bits = max(1, int(rank.max()).bit_length())
    each = 62 // bits
    keys = []
    for first in range(0, window, each):
        key = np.zeros(len(own), np.int64)
        for j in range(first, min(window, first + each)):
            key = key << bits | rank[at[own] + j]
        keys.append(key)
    order = np.lexsort(keys[::-1])
    new = np.ones(len(own), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return own[order], np.flatnonzero(new)


def later(ids: np.ndarray, own: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The suffixes whose node also has a leaf of a document with a smaller id, in order."""
    if not len(own):
        return NONE
    smallest = np.repeat(np.minimum.reduceat(ids[own], begins), np.diff(np.append(begins, len(own))))
    return np.sort(own[ids[own] > smallest])


def units(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Texts of a chunk with their offsets and the number of words before; a text longer than a chunk comes in pieces."""
    if len(part) == 1 and len(data) > CHUNK_BYTES:
        for piece, first in words.pieces(data, CHUNK_BYTES, overlap):
            yield piece, np.array([0, len(piece)]), first
    else:
        yield data, offsets, 0


def _count(window: int, cells: int):
    bits = np.uint64(64 - cells.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for part, whole, all_offsets in chunks(batch, "raw"):
                for data, offsets, _ in units(part, whole, all_offsets, window - 1):
                    starts, ends, before = words.split(data, offsets)
                    _, at = suffixes(before, np.arange(len(offsets) - 1), window)
                    least = landmarks(words.names(data, starts, ends), window)[0][at]
                    total += np.bincount((least >> bits).astype(np.int64), minlength=cells)
                    del starts, ends, before, at, least
        slices = list(range(0, cells, SLICE))
        yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), pa.array([total[i : i + SLICE].tobytes() for i in slices], pa.binary())], names=["slice", "counts"])

    return lambda batches: released(run(batches))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sums[i] = sums.get(i, 0) + np.frombuffer(counts.as_py(), np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "counts"])


def plan(counts: np.ndarray, partitions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each cell its first group, over how many groups it goes, and whether by windows rather than by landmarks.

    Cells that fit together share a group. Landmark hashes spread evenly, so a cell far beyond the mean holds a common landmark, which only
    the windows' own bits split.
    """
    share = max(1, -(-int(counts.sum()) // (partitions * GROUPS_EACH)))
    common = counts > COMMON * max(share, float(counts.mean()))
    first, parts, group, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for cell, n in enumerate(counts.tolist()):
        if n > share:
            group += held > 0
            first[cell], parts[cell] = group, -(-n // share)
            group, held = group + parts[cell], 0
            continue
        if held + n > share:
            group, held = group + 1, 0
        first[cell], held = group, held + n
    return first, parts, common


def large(counts: np.ndarray, first: np.ndarray, parts: np.ndarray, group_windows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each group, into how many slots it is dealt (1: it is met at once) and over how many finer groups what stays is spread.

    A cell that goes over several groups may hold one window only, which then all falls to one of them; so each of these groups has slots for the whole cell.
    """
    n_groups = int((first + parts).max())
    size, most = np.zeros(n_groups, np.int64), np.zeros(n_groups, np.int64)
    alone = parts == 1
    np.add.at(size, first[alone], counts[alone])
    most[:] = size
    for cell in np.flatnonzero(~alone).tolist():
        own = slice(first[cell], first[cell] + parts[cell])
        size[own], most[own] = -(-counts[cell] // parts[cell]), counts[cell]
    return np.maximum(1, -(-most // group_windows)), np.maximum(1, -(-size // group_windows))


def _pack(arrays: list[np.ndarray], text: bytes = b"", single: bool = False) -> bytes:
    """Arrays of integers, by bytes, and a text, compressed; the last array has numbers of windows, and single tells that each stretch is one."""
    head = zstandard.compress(b"".join(np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays), 1)
    sizes = np.array([int(arrays[-1].sum()), len(head), int(single), *map(len, arrays)], "<i8")
    return np.array([len(sizes)], "<i8").tobytes() + sizes.tobytes() + head + (zstandard.compress(text, 3) if text else b"")


def _packed(text: bytes, starts, ends, at, n, ids, sums, place, window: int, single: bool) -> bytes:
    """A blob of stretches: n suffixes from the word `at` on, which begin at a place of a document."""
    order = np.lexsort((sums, ids))
    new = np.ones(len(order), bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (sums[order][1:] != sums[order][:-1])
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    lead = order[new]
    stretches = b"\n".join([text[x:y] for x, y in zip(starts[at].tolist(), ends[at + n + window - 2].tolist(), strict=True)])
    return _pack([np.diff(ids[lead], prepend=0), sums[lead], np.diff(back, prepend=0), place, n], stretches, single)


def _unpack(blob: bytes) -> tuple[list[np.ndarray], bytes, bool]:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    _, size, single, *lengths = np.frombuffer(blob, "<i8", n, 8).tolist()
    at = 8 * (n + 1)
    raw, arrays, begin = np.frombuffer(zstandard.decompress(blob[at : at + size]), np.uint8), [], 0
    for length in lengths:
        arrays.append(np.ascontiguousarray(raw[begin : begin + 8 * length].reshape(8, -1).T).view("<i8").ravel())
        begin += 8 * length
    return arrays, zstandard.decompress(blob[at + size :]) if len(blob) > at + size else b"", bool(single)


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and length of each run of consecutive starts of one document."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    begins = np.flatnonzero(new)
    return begins, np.diff(np.append(begins, len(doc)))


def _ship(window: int, first: np.ndarray, parts: np.ndarray, common: np.ndarray, slots: np.ndarray = ONE):
    """Packed stretches of suffixes by group, and the slot of a large group that the chunk falls to; negative groups hold what a chunk has marked by itself."""
    bits = np.uint64(64 - len(first).bit_length() + 1)

    def blobs(ids, sums, data, offsets, base, order) -> Iterator[tuple[int, bytes, int]]:
        starts, ends, before = words.split(data, offsets)
        docs, at = suffixes(before, order, window)
        if not len(docs):
            return
        h = words.names(data, starts, ends)
        gone = later(ids[docs], *tree(data, starts, ends, h, at, window))
        place = at - before[:-1][docs] + base
        if len(gone):
            d, s = docs[gone], place[gone]
            b, n = _runs(d, s)
            yield -1 - int(h[0] % np.uint64(1 << 20)), _pack([ids[d[b]], sums[d[b]], s[b], n]), 0
            stay = np.ones(len(docs), bool)
            stay[gone] = False
            docs, at, place = docs[stay], at[stay], place[stay]
        least, where = (x[at] for x in landmarks(h, window))
        cell = (least >> bits).astype(np.int64)
        split = common[cell]
        path = np.where(split, words.grams(h, window)[at], words.mix(least)) if split.any() else words.mix(least)
        group = first[cell] + (path % parts[cell].astype(np.uint64)).astype(np.int64)
        new = np.ones(len(docs), bool)
        new[1:] = split[1:] | (docs[1:] != docs[:-1]) | (place[1:] != place[:-1] + 1) | (where[1:].astype(np.int64) != where[:-1].astype(np.int64) - 1)
        begins = np.flatnonzero(new)
        counts = np.diff(np.append(begins, len(docs)))
        by = np.argsort(group[begins], kind="stable")
        text, chunk = data.tobytes(), int(h[0] >> np.uint64(24))
        for own in np.split(by, np.flatnonzero(np.diff(group[begins[by]])) + 1) if len(by) else []:
            b, n = begins[own], counts[own]
            g = int(group[b[0]])
            yield g, _packed(text, starts, ends, at[b], n, ids[docs[b]], sums[docs[b]], place[b], window, bool(split[b[0]])), chunk % int(slots[min(g, len(slots) - 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, whole, all_offsets in chunks(batch, "raw"):
                has_id = np.flatnonzero(~np.asarray(part.column(0).is_null()))
                ids, sums = long_array(part.column(0)), long_array(part.column(2))
                order = has_id[np.argsort(ids[has_id], kind="stable")]
                for data, offsets, base in units(part, whole, all_offsets, window - 1):
                    out = list(blobs(ids, sums, data, offsets, base, order))
                    if out:
                        groups, packed, slot = zip(*out, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(packed, pa.binary()), pa.array(slot, pa.int64())], names=["grp", "blob", "slot"])

    return lambda batches: released(run(batches))


def windows_of(blob: bytes) -> int:
    """Number of suffixes in a packed blob."""
    return int(np.frombuffer(blob, "<i8", 1, 8)[0])


def unpacked(blobs: list[bytes], window: int, turn: int = 0, turns: int = 1) -> tuple[np.ndarray, ...] | None:
    """Of blobs, one after another: their bytes, words' starts and ends and names, and of each suffix its word, document, text sum and place. With turns, only of the
    suffixes whose path falls to this turn."""
    held: list[list[np.ndarray]] = [[] for _ in range(8)]
    n_bytes = n_words = 0
    for blob in blobs:
        (ids, sums, doc, place, n), text, single = _unpack(blob)
        data = np.frombuffer(text, np.uint8)
        starts, ends, _ = words.split(data, np.array([0, len(data)]))
        h = words.names(data, starts, ends)
        ids, doc = np.cumsum(ids), np.cumsum(doc)
        lead = np.cumsum(n + window - 1) - (n + window - 1)
        if turns > 1:
            mine = np.flatnonzero(words.mix(paths(h, lead, window, single)) % np.uint64(turns) == np.uint64(turn))
            if not len(mine):
                continue
            doc, place, n, lead = doc[mine], place[mine], n[mine], lead[mine]
            text = b"\n".join([text[x:y] for x, y in zip(starts[lead].tolist(), ends[lead + n + window - 2].tolist(), strict=True)])
            data = np.frombuffer(text, np.uint8)
            starts, ends, _ = words.split(data, np.array([0, len(data)]))
            h, lead = words.names(data, starts, ends), np.cumsum(n + window - 1) - (n + window - 1)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        for out, x in zip(held, (data, starts + n_bytes, ends + n_bytes, h, np.repeat(lead, n) + step + n_words, np.repeat(ids[doc], n), np.repeat(sums[doc], n), np.repeat(place, n) + step), strict=True):
            out.append(x)
        n_bytes, n_words = n_bytes + len(data), n_words + len(h)
    if not n_words:
        return None
    held.reverse()
    return tuple(np.concatenate(held.pop()) for _ in range(8))  # parts are let go one after another


def paths(h: np.ndarray, at: np.ndarray, window: int, single: bool) -> np.ndarray:
    """What decides where a suffix goes: the whole window if it goes by itself, else its landmark."""
    return words.grams(h, window)[at] if single else words.mix(landmarks(h, window)[0][at])


def _mark_runs(ids: np.ndarray, sums: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, text sum, first start and number of each run of consecutive starts."""
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (sums[1:] != sums[:-1]) | (place[1:] != place[:-1] + 1)
    b = np.flatnonzero(new)
    return ids[b], sums[b], place[b], np.diff(np.append(b, len(ids)))


def repeats(blobs: list[bytes], window: int, turn: int = 0, turns: int = 1) -> tuple[np.ndarray, ...]:
    """Of one group: document, text sum, first start and number of consecutive starts whose window also starts in a smaller document.

    With turns, only of the suffixes whose path falls to this turn.
    """
    found = unpacked(blobs, window, turn, turns)
    if found is None:
        return (NONE,) * 4
    data, starts, ends, h, at, ids, sums, place = found
    del found
    hit = later(ids, *tree(data, starts, ends, h, at, window))
    return _mark_runs(ids[hit], sums[hit], place[hit])


def reduced(blobs: list[bytes], window: int, fan: int) -> tuple[tuple[np.ndarray, ...], list[tuple[int, bytes]]]:
    """Of a part of a group: marks as in repeats, and what stays, packed by finer groups: of each window the suffixes of the smallest document."""
    found = unpacked(blobs, window)
    if found is None:
        return (NONE,) * 4, []
    single = _unpack(blobs[0])[2]
    data, starts, ends, h, at, ids, sums, place = found
    hit = later(ids, *tree(data, starts, ends, h, at, window))
    stay = np.ones(len(at), bool)
    stay[hit] = False
    rest = np.flatnonzero(stay)
    sub = (words.mix(paths(h, at[rest], window, single)) % np.uint64(fan)).astype(np.int64)
    new = np.ones(len(rest), bool)
    new[1:] = single | (at[rest][1:] != at[rest][:-1] + 1) | (ids[rest][1:] != ids[rest][:-1]) | (sums[rest][1:] != sums[rest][:-1]) | (place[rest][1:] != place[rest][:-1] + 1) | (sub[1:] != sub[:-1])
    lead = np.flatnonzero(new)
    counts, text, out = np.diff(np.append(lead, len(rest))), data.tobytes(), []
    by = np.argsort(sub[lead], kind="stable")
    for own in np.split(by, np.flatnonzero(np.diff(sub[lead[by]])) + 1) if len(by) else []:
        b = rest[lead[own]]
        out.append((int(sub[lead[own[0]]]), _packed(text, starts, ends, at[b], counts[own], ids[b], sums[b], place[b], window, single)))
    return _mark_runs(ids[hit], sums[hit], place[hit]), out


def _meet(window: int, group_windows: int, slots: np.ndarray, fans: np.ndarray):
    """Groups that are met at once give their marks (without grp); a slot of a large group gives marks and blobs for finer groups, a stretch of suffixes at a time."""
    base = np.append(0, np.cumsum(fans))

    def marked(d, t, s, n) -> pa.RecordBatch:
        none = [pa.nulls(len(d), pa.int64()), pa.nulls(len(d), pa.binary())]
        return pa.RecordBatch.from_arrays([*(pa.array(np.asarray(x, np.int64)) for x in (d, t, s, n)), *none], names=["doc_id", "sum", "first", "n", "grp", "blob"])

    def ended(group: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        if slots[group] == 1:
            turns = -(-sum(windows_of(blob) for blob in held) // group_windows)
            for turn in range(turns):
                yield marked(*repeats(held, window, turn, turns))
            return
        marks, rest = reduced(held, window, int(fans[group]))
        yield marked(*marks)
        if rest:
            none = [pa.nulls(len(rest), pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*none, pa.array([int(base[group]) + sub for sub, _ in rest]), pa.array([blob for _, blob in rest], pa.binary())], names=["doc_id", "sum", "first", "n", "grp", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0
        for batch in batches:
            for g, blob, slot in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if g < 0:
                    yield marked(*_unpack(blob.as_py())[0])
                    continue
                if held and ((g, slot) != key or slots[g] > 1 and size >= group_windows):
                    yield from ended(key[0], held)
                    held, size = [], 0
                key = (g, slot)
                held.append(blob.as_py())
                size += windows_of(held[-1])
        if held:
            yield from ended(key[0], held)

    return lambda batches: released(run(batches))


def _mark(window: int, group_windows: int):
    """Marks of groups that are met at once."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for g, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if g < 0:
                    yield marks(*_unpack(blob.as_py())[0])
                    continue
                if held and g != group:
                    yield from ended(held)
                    held = []
                group = g
                held.append(blob.as_py())
        if held:
            yield from ended(held)

    def marks(d, t, s, n):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (d, t, s, n)], names=["doc_id", "sum", "first", "n"])

    def ended(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        turns = -(-sum(windows_of(blob) for blob in held) // group_windows)
        for turn in range(turns):
            yield marks(*repeats(held, window, turn, turns))

    return lambda batches: released(out(batches))


def _kept(window: int, with_text: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text

    def joined(data, starts, ends, keep) -> tuple[bytes, np.ndarray]:
        """The words that stay, a space after each, and the byte where each word would begin."""
        s, lengths = starts[keep], (ends - starts)[keep]
        upto = np.append(0, np.cumsum(lengths + 1))
        text = np.full(int(upto[-1]), 32, np.uint8)
        step = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        text[np.repeat(upto[:-1], lengths) + step] = data[np.repeat(s, lengths) + step]
        return text.tobytes(), upto[np.append(0, np.cumsum(keep))]

    def long_text(data: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[int, int, str, list[bytes]]:
        """One text by pieces."""
        order = np.argsort(first)
        begin, end = first[order], np.maximum.accumulate((first + n + window - 1)[order]) if len(first) else NONE
        total, kept, digest, texts = 0, 0, hashlib.sha256(), []
        for piece, _ in words.pieces(data, CHUNK_BYTES):
            starts, ends, _ = words.split(piece, np.array([0, len(piece)]))
            number = np.arange(total, total + len(starts))
            covering = np.searchsorted(begin, number, "right") - 1
            keep = ~((covering >= 0) & (number < end[np.maximum(covering, 0)])) if len(begin) else np.ones(len(starts), bool)
            text = joined(piece, starts, ends, keep)[0][:-1]
            if keep.any():
                digest.update(b" " * (kept > 0) + text)
                texts.append(text)
            total, kept = total + len(starts), kept + int(keep.sum())
        return total, total - kept, digest.hexdigest(), texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in chunks(batch, "raw"):
                lists, counts = part.column(2), part.column(3)
                first, many = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (lists, counts))
                if len(part) == 1 and len(data) > CHUNK_BYTES:
                    total, gone, digest, texts = long_text(data, first, many)
                    columns = [part.column(0), pa.array([total]), pa.array([gone]), pa.array([digest])] + [pa.array([b" ".join(texts)], pa.binary()).cast(pa.string())] * with_text
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    continue
                starts, ends, before = words.split(data, offsets)
                cover = np.zeros(len(starts) + 1, np.int64)
                rows = np.repeat(np.arange(len(part)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                begin = before[:-1][rows] + first
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + many + window - 1, -1)
                keep = np.cumsum(cover)[:-1] == 0
                text, place = joined(data, starts, ends, keep)
                begin = place[before[:-1]]
                end = np.maximum(place[before[1:]] - 1, begin)
                texts = [text[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
                n = np.diff(before)
                columns = [part.column(0), pa.array(n.astype(np.int64)), pa.array(n - np.diff(np.append(0, np.cumsum(keep))[before])), pa.array([hashlib.sha256(x).hexdigest() for x in texts])]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.binary()).cast(pa.string())] * with_text, names=names)

    return lambda batches: released(run(batches))


def _marks(summed: DataFrame, window: int, group_windows: int) -> DataFrame:
    """Runs of starts whose window also starts in a smaller document: doc_id, sum, first, n."""
    spark = summed.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = min(MOST_CELLS, max(CELLS, 1 << (CELLS_EACH * partitions * GROUPS_EACH - 1).bit_length()))
    kind = "slice long, counts binary"
    counted = summed.select("doc_id", "raw").mapInArrow(_count(window, cells), kind).repartition("slice").mapInArrow(_summed, kind)
    counts = np.zeros(cells, np.int64)
    for row in counted.collect():  # MOST_CELLS numbers at most
        counts[row.slice : row.slice + SLICE] = np.frombuffer(row.counts, np.int64)
    first, parts, common = plan(counts, partitions)
    slots, fans = large(counts, first, parts, group_windows)
    shipped = summed.mapInArrow(_ship(window, first, parts, common, slots), "grp long, blob binary, slot long")
    if slots.max() == 1:
        return shipped.select("grp", "blob").repartition("grp").sortWithinPartitions("grp").mapInArrow(_mark(window, group_windows), MARK_TYPE)
    dealt = shipped.repartition("grp", "slot").sortWithinPartitions("grp", "slot")
    met = written(dealt.mapInArrow(_meet(window, group_windows, slots, fans), f"{MARK_TYPE}, grp long, blob binary"), f"{work_folder(spark, 'substrings')}/met")
    finer = met.where("grp IS NOT NULL").select("grp", "blob").repartition("grp").sortWithinPartitions("grp")
    return met.where("grp IS NULL").drop("grp", "blob").union(finer.mapInArrow(_mark(window, group_windows), MARK_TYPE))


def _summed_texts(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, raw, and a sum of the text that tells rows of one doc_id apart; 0 if no doc_id comes twice."""
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    once = ids.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("kinds")).first()
    raw = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("raw"))
    return raw.withColumn("sum", F.xxhash64("raw") if once.n > once.kinds else F.lit(0).cast("long"))


def repeated_passages(docs: DataFrame, window: int = 13, group_windows: int = GROUP_WINDOWS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, first, n_words of the maximal passages all whose windows also start in documents of smaller doc_id; places count from 0.

    Rows that share doc_id and text give the same passages, which come once.
    """
    marks = _marks(_summed_texts(docs, text, doc_id), window, group_windows)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: list[list[int]] = []
                for run in sorted((r["first"], r["n"]) for r in runs):
                    if own and run[0] <= own[-1][0] + own[-1][1]:
                        own[-1][1] = max(own[-1][1], run[0] + run[1] - own[-1][0])
                    else:
                        own.append(list(run))
                rows += [(doc, a, n + window - 1) for a, n in own]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "first", "n_words"])

    grouped = marks.groupBy("doc_id", "sum").agg(F.collect_list(F.struct("first", "n")).alias("runs"))  # the runs of one text
    return grouped.select("doc_id", "runs").mapInArrow(merge, "doc_id long, first long, n_words long")


def remove_repeats(docs: DataFrame, window: int = 13, with_text: bool = False, group_windows: int = GROUP_WINDOWS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    Words are `[^\\x20\\x09-\\x0D]+`; null and blank texts have none. A word goes if a window of `window` words covers it whose words
    also start in a document of smaller doc_id; kept words are joined by one space. Rows of one doc_id don't affect each other (two of them with
    different texts are told apart by 64 bits); rows without doc_id stay whole and affect none. A text of any length that Spark holds (2 GB)
    is worked on in pieces of 4 MB. Other columns of docs are not looked at.
    """
    summed = _summed_texts(docs, text, doc_id)
    marks = _marks(summed, window, group_windows).groupBy("doc_id", "sum").agg(F.collect_list(F.struct("first", "n")).alias("marks"))
    marks = marks.select("doc_id", "sum", F.col("marks.first").alias("first"), F.col("marks.n").alias("n"))
    joined = summed.join(marks.hint("merge"), ["doc_id", "sum"], "left").select("doc_id", "raw", "first", "n")
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.mapInArrow(_kept(window, with_text), kind)
