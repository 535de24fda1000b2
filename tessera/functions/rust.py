"""Top-level items of Rust sources, by a scan that knows comments, strings, characters, lifetimes and brackets.

One pattern finds what is no code; from there on a text is arrays: signs that count, the depth of brackets as a running sum that never falls below zero, and the places where an
item can end. Python then steps from item to item, not from character to character.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed list: the items that a top-level span can be.
KINDS = ("fn", "impl", "struct", "enum", "trait", "mod")
SPAN = T.ArrayType(T.StructType([*[T.StructField(x, T.IntegerType()) for x in ("start", "end", "bytes")], T.StructField("kind", T.StringType())]))
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_RAW = re.compile(r"(?<!\w)b?r(\#*)$")
_MARK = re.compile(r"'(?:[^'\\\n]|\\.[^'\n]*)'|'[A-Za-z_]\w*", re.S)
_BLOCK = re.compile(r"/\*|\*/")
_WORD, _WORD_SIGN = re.compile(r"[A-Za-z_]\w*"), re.compile(r"\w")
_KIND = re.compile(rf"(?<!\w)(?:{'|'.join(KINDS)})(?!\w)")
#: For code points below its length: whether they are blank. Later ones are not.
_BLANK = np.array([chr(i).isspace() for i in range(0x3001)])
_STEP = np.zeros(128, np.int8)
_STEP[[ord(x) for x in "[({"]], _STEP[[ord(x) for x in "])}"]] = 1, -1


def _comment_end(code: str, at: int) -> int:
    """Block comments nest."""
    depth = 0
    for found in _BLOCK.finditer(code, at):
        depth += 1 if found[0] == "/*" else -1
        if not depth:
            return found.end()
    return len(code)


def _quiet(code: str, points: np.ndarray) -> np.ndarray:
    """Whether each place belongs to a comment, string, character or lifetime. Such things begin at quotes and at slashes before a slash or a star; arrays find those."""
    slash = points == 47
    slash[:-1] &= (points[1:] == 47) | (points[1:] == 42)
    begins = np.flatnonzero((points == 34) | (points == 39) | slash).tolist()
    starts, ends, upto = [], [], 0
    for start in begins:
        if start < upto:
            continue
        sign, end = code[start], -1
        if sign == "/":
            if code.startswith("/*", start):
                end = _comment_end(code, start)
            elif code.startswith("//", start):
                end = code.find("\n", start)
                end = len(code) if end < 0 else end
        elif sign == "'":
            found = _MARK.match(code, start)
            end = found.end() if found else -1
            if end > start + 1 and code[end - 1] == "'" and code[start - 1 : start] == "b" and start - 1 >= upto and not (start > 1 and _WORD_SIGN.match(code[start - 2])):
                start -= 1
        else:
            raw = _RAW.search(code, max(upto, start - 260), start) if code[start - 1 : start] in ("r", "#") else None
            if raw:
                close = code.find(f'"{raw[1]}', start + 1)
                if close >= 0:
                    start, end = raw.start(), close + 1 + len(raw[1])
            if end < 0 and (found := _STRING.match(code, start)):
                end = found.end()
                if code[start - 1 : start] == "b" and start - 1 >= upto and not (start > 1 and _WORD_SIGN.match(code[start - 2])):
                    start -= 1
        if end >= 0:
            starts.append(start)
            ends.append(end)
            upto = end
    edge = np.zeros(len(code) + 1, np.int8)
    edge[starts] += 1
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


class Signs:
    """The signs of a text that is code: where they are, and the depth of brackets."""

    def __init__(self, code: str):
        points = np.frombuffer(code.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.code, self.quiet = code, _quiet(code, points)
        self.solid = np.flatnonzero(~_BLANK[np.minimum(points, len(_BLANK) - 1)] & ~self.quiet)
        small = points[self.solid] < 128
        step = np.where(small, _STEP[np.where(small, points[self.solid], 0)], 0)
        event = (step != 0) | (points[self.solid] == ord(";"))
        self.at, step = self.solid[event], step[event].astype(np.int64)
        total = np.cumsum(step)
        self.depth = total - np.minimum(np.minimum.accumulate(total), 0) if len(total) else total  # after each sign
        closing, top = points[self.at], self.depth == 0
        self.ends = self.at[top & ((closing == ord(";")) | (closing == ord("}")))].tolist()
        self.closed = self.at[top & (step < 0)].tolist()
        self.at, self.depth = self.at.tolist(), self.depth.tolist()

    def code_after(self, at: int) -> int:
        """The first sign from a place on, or -1."""
        i = int(self.solid.searchsorted(at))
        return int(self.solid[i]) if i < len(self.solid) else -1

    @staticmethod
    def after(places: list[int], at: int) -> int:
        """The first of some places from `at` on, or -1."""
        i = bisect_left(places, at)
        return places[i] if i < len(places) else -1

    def attribute_end(self, at: int) -> int:
        """The place after the attribute that begins with the # at a place, or -1 if it never ends."""
        to = self.code_after(at + 1)
        while to >= 0 and self.code[to] == "!":
            to = self.code_after(to + 1)
        if to < 0:
            return -1
        if self.code[to] in "[({":
            return self.after(self.closed, to) + 1 or -1
        word = _WORD.match(self.code, to)
        return word.end() if word else to + 1

    def kind(self, start: int, end: int) -> str | None:
        """The first word outside of brackets that names an item."""
        for found in _KIND.finditer(self.code, start, end):
            i = bisect_left(self.at, found.start())
            if not self.quiet[found.start()] and (i == 0 or self.depth[i - 1] == 0):
                return found[0]
        return None


def items(code: str) -> list[tuple[int, int, int, str]]:
    """(start, end, bytes, kind) of the items at the top level, from their visibility on; attributes are not part of an item.

    An item ends at the brace that closes it, or at a semicolon outside of brackets. What is never closed is no item.
    """
    signs, out, at = Signs(code), [], 0
    while (start := signs.code_after(at)) >= 0:
        if code[start] == "#":
            if (at := signs.attribute_end(start)) < 0:
                break
            continue
        end = signs.after(signs.ends, start) + 1
        if not end:
            break
        kind = signs.kind(start, end)
        if kind:
            out.append((start, end, len(code[start:end].encode("utf-8", "replace")), kind))
        at = end
    return out


@F.arrow_udf(SPAN)
def top_level(code: pa.Array) -> pa.Array:
    """Items of each text; null has none. Texts are opened one at a time, and of each only its items' numbers stay: a batch doesn't become objects as a whole."""
    upto, numbers = [0], array("i")
    for c in code:
        for start, end, size, kind in items(c.as_py() or ""):
            numbers.extend((start, end, size, KINDS.index(kind)))
        upto.append(len(numbers) // 4)
    columns = [pa.array(x) for x in np.array(numbers, np.int32).reshape(-1, 4).T.copy()]
    spans = pa.StructArray.from_arrays([*columns[:3], pa.array(KINDS).take(columns[3])], names=["start", "end", "bytes", "kind"])
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), spans)


def middle(code: Column) -> Column:
    """Struct (start, end) of the largest item by bytes, the first one on ties; null for texts without `fn ` or without items."""
    largest = F.array_max(F.transform(top_level(code), lambda x: F.struct(x["bytes"], (-x["start"]).alias("order"), x["start"].alias("start"), x["end"].alias("end"))))
    return F.when(code.contains("fn ") & largest.isNotNull(), F.struct(largest["start"].alias("start"), largest["end"].alias("end")))


def functions_in(code: Column, least: int = 40) -> Column:
    """Sources of functions and impls at the top level of at least so many bytes."""
    own = F.filter(top_level(code), lambda x: x["kind"].isin("fn", "impl") & (x["bytes"] >= least))
    return F.transform(own, lambda x: F.substring(code, x["start"] + 1, x["end"] - x["start"]))


class Functions:
    """Table function rust_items(code): a row for each item at the top level."""

    def eval(self, code: str):
        for start, end, size, kind in items(code or ""):
            yield start, end, size, kind, code[start:end]


class Needs:
    """Table function package_needs(manifest): a row for each package that a manifest names as a dependency, without itself; none for a broken manifest."""

    def eval(self, manifest: str):
        for name, deps in package(manifest or ""):
            for dep in deps:
                yield name, dep


def package(manifest: str) -> list[tuple[str, list[str]]]:
    """The package's name and its dependencies of all three kinds, or nothing."""
    import tomllib

    try:
        spec = tomllib.loads(manifest)
    except tomllib.TOMLDecodeError:
        return []
    name = spec.get("package", {}).get("name")
    return [(name, sorted({d for part in ("dependencies", "dev-dependencies", "build-dependencies") for d in spec.get(part, {})} - {name}))] if name else []


def register(spark) -> None:
    """Makes both table functions callable in SQL, also in a LATERAL join."""
    spark.udtf.register("rust_items", F.udtf(Functions, returnType="start int, end int, bytes int, kind string, source string"))
    spark.udtf.register("package_needs", F.udtf(Needs, returnType="name string, dep string"))
