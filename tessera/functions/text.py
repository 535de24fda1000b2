"""Text expressions: globs, rewriting, extraction."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sentinels of fill-in-the-middle samples.
PREFIX, SUFFIX, MIDDLE = "<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>"
CLOSES = r"(?i)\b(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s+#(\d+)"
CRATE = r"^crates/([^/]+)/"
FUNCTION = r"(?s)fn\s+\w+.*?\n}\n"
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def glob_regex(glob: str) -> str:
    """A shell pattern as a regular expression over whole paths; a star also crosses slashes."""
    out = ""
    i = 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "" if out.endswith(".*") else ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2 :]:
            j = glob.index("]", i + 2)
            inner = glob[i + 1 : j].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}\\z"


def matches(path: Column, include: list[str], exclude: list[str] = ()) -> Column:
    """Whether any include pattern and no exclude pattern fits the whole path."""
    some = F.lit(False)
    for g in include:
        some = some | path.rlike(glob_regex(g))
    for g in exclude:
        some = some & ~path.rlike(glob_regex(g))
    return some


def is_test_file(path: Column) -> Column:
    return path.contains("/tests/") | path.endswith("_test.rs") | path.startswith("tests/")


def crates_touched(paths: Column) -> Column:
    """Sorted distinct crate names of paths crates/<name>/..."""
    names = F.transform(paths, lambda p: F.regexp_extract(p, CRATE, 1))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: x != "")))


def in_scope(path: Column) -> Column:
    """Whether a path is a source of a package, or a file outside of all packages."""
    return path.rlike(r"^crates/[^/]+/(?s:.*)\.rs\z") | ~path.contains("crates/")


def closing_issue(body: Column) -> Column:
    """Number of the first issue that a text says it closes; null if none."""
    return F.nullif(F.regexp_extract(body, CLOSES, 1), F.lit("")).cast("long")


def strip_template(text: Column) -> Column:
    """A change description without comments, checklist lines, template headers and runs of blank lines."""
    # fixed values: the patterns of what goes
    lines = F.split(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), LINE_ENDS, -1)
    out = F.array_join(F.filter(lines, lambda x: ~x.rlike(r"(?U)^\s*-\s*\[[ xX]\]")), "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"(?mdU)^#+\s*(Type of Change|Checklist|Motivation and Context)\s*$\n?", "")
    return F.regexp_replace(out, r"(?U)^\s+|\s+\z", "")


def fim(text: Column, mode: Column, span: Column | None = None) -> Column:
    """Text cut in thirds, the middle one last; mode psm has the prefix first, others the suffix.

    span, a struct (start, end) of code points, says what the middle is where it isn't null.
    """
    n = F.char_length(text)
    a, b = F.floor(n / 3).cast("int"), F.floor(n * 2 / 3).cast("int")
    if span is not None:
        a, b = F.coalesce(span["start"], a), F.coalesce(span["end"], b)
    head, middle, tail = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b - a), F.substring(text, b + 1, n)
    first, second = F.concat(F.lit(PREFIX), head), F.concat(F.lit(SUFFIX), tail)
    return F.when(mode == "psm", F.concat(first, second, F.lit(MIDDLE), middle)).otherwise(F.concat(second, first, F.lit(MIDDLE), middle))


def file_sample(path: Column, content: Column) -> Column:
    return F.concat(F.lit("// File: "), path, F.lit("\n"), content)


def commit_sample(subject: Column, diff: Column, longest: int = 20_000) -> Column:
    return F.concat(F.lit("# Commit intent\n"), subject, F.lit("\n\n# Change\n"), F.substring(diff, 1, longest))


def pr_sample(number: Column, title: Column, body: Column, files: Column) -> Column:
    return F.concat(F.lit("# PR #"), number.cast("string"), F.lit(": "), title, F.lit("\n\n"), body, F.lit("\n\n# Files changed\n"), F.array_join(files, "\n"))


def approximate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4)).cast("long")


def extract_patch(text: Column) -> Column:
    """Body of the first diff fence, else of the first fence, else the text; one newline at its end, and blank ones empty."""
    # fixed values: the patterns of fences
    marked, fenced = (F.regexp_extract(text, p, 1) for p in (r"(?s)```(?:diff|patch)\n(.*?)\n```", r"(?s)```[a-zA-Z]*\n(.*?)\n```"))
    has = lambda p: text.rlike(p)
    body = F.when(has(r"(?s)```(?:diff|patch)\n(.*?)\n```"), marked).when(has(r"(?s)```[a-zA-Z]*\n(.*?)\n```"), fenced).otherwise(text)
    return F.when(body.rlike(r"(?U)\S"), F.concat(F.regexp_replace(body, r"\n+\z", ""), F.lit("\n"))).otherwise(F.lit(""))


def teacher_json(text: Column) -> Column:
    """JSON text of a model's reply without its thoughts: all of it, or from the first to the last brace; null if neither parses."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?U)^\s+|\s+\z", "")
    inner = F.regexp_extract(plain, r"(?s)\{.*\}", 0)


    def parsed(x: Column) -> Column:
        """Whether x is one JSON value and nothing else; the parser by itself overlooks what follows."""
        whole = F.try_parse_json(F.concat(F.lit("["), x, F.lit("]")))
        return F.try_variant_get(whole, "$[0]", "variant").isNotNull() & F.try_variant_get(whole, "$[1]", "variant").isNull()

    return F.when(parsed(plain), plain).when((inner != "") & parsed(inner), inner)


def functions_in(code: Column, least: int = 40) -> Column:
    """Function sources in a code text, each from `fn` to a closing brace at a line's start."""
    return F.filter(F.regexp_extract_all(code, F.lit(FUNCTION), F.lit(0)), lambda x: F.char_length(x) >= least)


def appliable_patch(diff: Column, path: Column) -> Column:
    """A diff whose first `--- ` and first `+++ ` line name a/path and b/path; other lines stay."""
    cut = F.split(diff, LINE_ENDS, -1)
    lines = F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
    first = lambda sign: F.array_position(F.transform(lines, lambda x: x.startswith(sign)), F.lit(True))
    minus, plus = first("--- "), first("+++ ")
    fixed = F.transform(lines, lambda x, i: F.when(i + 1 == minus, F.concat(F.lit("--- a/"), path)).when(i + 1 == plus, F.concat(F.lit("+++ b/"), path)).otherwise(x))
    return F.concat(F.array_join(fixed, "\n"), F.lit("\n"))
