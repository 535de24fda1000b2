"""Token sequences of several lengths: documents are routed to tiers, tiers are packed, gaps of long windows are filled from shorter tiers.

Each task packs the documents of its own partition, so nothing is shuffled. A document's ids are cut into windows of the longest tier, which are
put out at once; what is left goes to the shortest tier that holds it. Tiers are packed from the longest down: a piece opens a window, the largest
pieces of shorter tiers that fit fill it, and the last gap takes a cut from the shortest tier at hand, so that every window is exactly full. What a
task has left at its end goes to full windows of shorter tiers; only a rest under the shortest tier is padded, one sequence a task.

Step groups have the same number of tokens: short sequences wait until they make up the longest tier, two by two, and step groups are filled by
whole such units, so every group of a task but its last one is full. A task holds `HELD` ids of rests, one unfinished unit and the document at hand.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_bytes

TIERS = (128, 256, 512, 1024)
END = 0
#: Tokens of rests that a task holds before it packs them, and tokens of a step group.
HELD, STEP_TOKENS = 2 << 20, 64 * 1024
#: Rows of a batch that a task returns, and characters that are encoded at once.
ROWS, PIECE_CHARS = 20_000, 4 << 20
SEQUENCES_EACH = 1 << 40
PIECE_TYPE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
#: Fixed value: how byte-level BPE splits a text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Text on which the fast encoder must agree with the tokenizer's own before it is used.
PROBE = "It's 1,234.5 — naïve  café\n\n\tЖж 東京 😀 a_b  'tis don'T x" + "ab" * 40 + " end    z"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    own = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str):
    """A function from a text to its ids as numpy, the same as the tokenizer file gives without added special tokens.

    A byte-level BPE vocabulary runs on the faster of two libraries if both agree on a probe; texts with a special token's string, and
    other vocabularies, go through the tokenizer itself.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    slow = lambda text: np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = [x["content"] for x in spec.get("added_tokens", [])]
    letters = byte_letters()
    try:
        import tiktoken

        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        fast = tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        if fast.encode_ordinary(PROBE) != slow(PROBE).tolist():
            return slow
    except (ImportError, KeyError, TypeError, ValueError):
        return slow
    quick = lambda text: fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)
    return lambda text: slow(text) if any(x in text for x in special) else np.concatenate([quick(x) for x in text_pieces(text)])


def text_pieces(text: str) -> Iterator[str]:
    """A long text cut before single blanks between word characters, where WORD_PATTERN always begins a word."""
    at, cut = 0, re.compile(r"(?<=\w) (?=\w)")
    while len(text) - at > PIECE_CHARS and (found := cut.search(text, at + PIECE_CHARS)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class Packer:
    """Packs pieces (document, start, ids) of one partition; rows() gives what is finished.

    Tiers are powers of two.
    """

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step_tokens = tuple(sorted(tiers)), step_tokens
        if any(t & (t - 1) for t in self.tiers) or step_tokens % self.tiers[-1]:
            raise ValueError("tiers are powers of two, and step groups whole numbers of the longest one")
        self.first = partition * SEQUENCES_EACH
        self.queues = {t: deque() for t in self.tiers}
        self.held, self.sequences, self.units, self.out = 0, 0, 0, []
        self.waiting: dict[int, list] = {}

    def add(self, doc, ids: np.ndarray) -> None:
        longest, n, at = self.tiers[-1], len(ids), 0
        while n - at >= longest:
            self.deal(longest, [(longest, [(doc, n, at, ids[at : at + longest])])])
            at += longest
        if at < n:
            self.queue(doc, n, at, ids[at:].copy())
        if self.held >= HELD:
            self.pack()

    def queue(self, doc, n: int, at: int, ids: np.ndarray) -> None:
        self.queues[next(t for t in self.tiers if t >= len(ids))].append((doc, n, at, ids))
        self.held += len(ids)

    def take(self, most: int, tiers) -> tuple | None:
        """The first piece of the longest of tiers that has one of at most so many ids."""
        for t in reversed(tiers):
            if self.queues[t] and len(self.queues[t][0][3]) <= most:
                piece = self.queues[t].popleft()
                self.held -= len(piece[3])
                return piece
        return None

    def window(self, tier: int) -> None:
        """One full window of a tier; needs so many ids held in it and shorter tiers."""
        pieces, gap, shorter = [], tier, [t for t in self.tiers if t <= tier]
        while gap:
            piece = self.take(gap, shorter)
            if piece is None:
                doc, n, at, ids = self.take(tier, [next(t for t in shorter if self.queues[t])])
                piece = (doc, n, at, ids[:gap])
                self.queue(doc, n, at + gap, ids[gap:])
            pieces.append(piece)
            gap -= len(piece[3])
        self.deal(tier, [(tier, pieces)])

    def in_tiers(self, upto: int) -> int:
        return sum(len(p[3]) for t in self.tiers if t <= upto for p in self.queues[t])

    def pack(self, last: bool = False) -> None:
        for tier in reversed(self.tiers):
            there = self.in_tiers(tier)
            while self.queues[tier] and there >= tier or last and there >= tier:
                self.window(tier)
                there -= tier
            if self.queues[tier] and tier > self.tiers[0] and last:  # too few ids: they go down in parts
                half = self.tiers[self.tiers.index(tier) - 1]
                for doc, n, at, ids in [self.queues[tier].popleft() for _ in range(len(self.queues[tier]))]:
                    self.held -= len(ids)
                    for i in range(0, len(ids), half):
                        self.queue(doc, n, at + i, ids[i : i + half])
        if last and self.held:
            pieces = []
            while (piece := self.take(self.tiers[0], self.tiers)) is not None:
                pieces.append(piece)
            self.deal(self.tiers[-1], [(self.tiers[-1], pieces)])
        if last:  # under one unit: they share the last step group
            for size in sorted(self.waiting, reverse=True):
                self.number(self.waiting[size])
            self.waiting = {}

    def deal(self, size: int, sequences: list[tuple[int, list]]) -> None:
        """Takes sequences of size tokens together; equal sizes are joined until they make up the longest tier, a unit of step groups."""
        while size < self.tiers[-1]:
            if size not in self.waiting:
                self.waiting[size] = sequences
                return
            sequences = self.waiting.pop(size) + sequences
            size *= 2
        self.number(sequences)
        self.units += 1

    def number(self, sequences: list[tuple[int, list]]) -> None:
        group = self.first + self.units * self.tiers[-1] // self.step_tokens
        for tier, pieces in sequences:
            offset = 0
            for doc, n, at, ids in pieces:
                self.out.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.first + self.sequences, offset, tier, group))
                offset += len(ids)
            self.sequences += 1

    def rows(self, last: bool = False) -> pa.RecordBatch | None:
        if last:
            self.pack(last=True)
        if not self.out:
            return None
        columns, self.out = list(zip(*self.out, strict=True)), []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 7 else pa.int64()) for i, c in enumerate(columns)], names=[x.split()[0] for x in PIECE_TYPE.split(", ")])


def _pack(path: str, tiers: tuple[int, ...], end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path), Packer(TaskContext.get().partitionId(), tiers)
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(raw.as_py().decode("utf-8", "replace"))
                packer.add(doc, np.append(ids, np.uint32(end)))
                if len(packer.out) >= ROWS:
                    yield packer.rows()
        if (rows := packer.rows(last=True)) is not None:
            yield rows

    return run


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, end: int = END, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    A document is its text's ids and the id `end`; null and empty texts are that id alone. Rows are packed one by one, repeated ones
    too, and rows without doc_id keep null. Sequences of a tier's length (powers of two) are full; a shorter one is padded to the longest tier.
    Long texts are encoded in pieces; a task holds the ids of one document (4 bytes each) beside what it has queued. Other columns of docs are not
    looked at.
    """
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("raw")).mapInArrow(_pack(tokenizer, tuple(tiers), end), PIECE_TYPE)
