"""Expressions against literal cases and plain Python."""

import fnmatch
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import config, hashing, rust, stats, text


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()])
    return frame.select(column.alias("x")).first()["x"]


def many(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("x")).orderBy("i").collect()
    return [r.x for r in rows]


def test_path_hash(spark):
    paths = ["crates/a/0.rs", "crates/router/src/refunds.rs", "README.md", "", "é/😀", *(f"p{i}" for i in range(200))]
    assert many(spark, hashing.path_hash, paths) == [int(hashlib.sha256(p.encode()).hexdigest(), 16) % 10_000 for p in paths]
    assert hashing.percent(0.29) == 28 and hashing.percent(0) == 0


@pytest.mark.parametrize("glob", ["**/README.md", "docs/**/*.md", "crates/**/*.rs", "*.r?", "a[!b]c", "a[bc]*", "x.y"])
def test_globs(spark, glob):
    paths = ["README.md", "a/README.md", "docs/a.md", "docs/x/a.md", "crates/a/src/x/y.rs", "z.rs", "axc", "abc", "ab", "x.y", "xzy", "a/b.rs\n"]
    assert many(spark, lambda c: text.matches(c, [glob]), paths) == [fnmatch.fnmatchcase(p, glob) for p in paths]


def test_fim(spark):
    got = [one(spark, text.fim(F.col("t"), F.lit(m)), t="abcdefghi") for m in ("psm", "spm")]
    assert got == ["<|fim_prefix|>abc<|fim_suffix|>ghi<|fim_middle|>def", "<|fim_suffix|>ghi<|fim_prefix|>abc<|fim_middle|>def"]
    assert one(spark, text.fim(F.col("t"), F.lit("psm")), t="") == "<|fim_prefix|><|fim_suffix|><|fim_middle|>"


def test_closing_issue(spark):
    cases = {"Fixes #12 and closes #9": 12, "prefix #3": None, "CLOSED  #7": 7, "fix: #4": None, "resolve #5x": 5, "": None}
    assert many(spark, text.closing_issue, list(cases)) == list(cases.values())


def test_template(spark):
    body = "<!-- a\nb -->Hello\n\n\n\n- [x] done\n  - [ ] no\n## Type of Change\nprose\r\nmore\n### Checklist  \n\n"
    assert many(spark, text.strip_template, [body, "", "<!-- x -->"]) == ["Hello\n\nprose\nmore", "", ""]


def test_patches(spark):
    cases = {"```rust\nx\n```\n```diff\n--- a\n+b\n\n```": "--- a\n+b\n", "raw\n\n": "raw\n", "  \n": "", "```\nq\n```": "q\n"}
    assert many(spark, text.extract_patch, list(cases)) == list(cases.values())
    diff = "--- old\n+++ replace\n@@\n--- c\n+++ d"
    assert many(spark, lambda c: text.appliable_patch(c, F.lit("f.rs")), [diff]) == ["--- a/f.rs\n+++ b/f.rs\n@@\n--- c\n+++ d\n"]


def test_teacher_json(spark):
    cases = {'<think>a {x}</think>{"problem":"p"}': '{"problem":"p"}', 'pre {"a":1} post': '{"a":1}', "no": None, 'a {"x":1} b {"y":2}': None, "": None}
    assert many(spark, text.teacher_json, list(cases)) == list(cases.values())


def test_functions_and_crates(spark):
    code = "fn a() {\n  body that is long enough to count\n}\nfn b() {\n}\n"
    assert many(spark, text.functions_in, [code]) == [[m for m in re.findall(r"(?s)fn\s+\w+.*?\n}\n", code) if len(m) >= 40]]
    assert one(spark, text.crates_touched(F.col("p")), p=["crates/b/x.rs", "crates/a/y.rs", "crates/b/z", "docs/q"]) == ["a", "b"]
    assert one(spark, text.is_test_file(F.lit("tests/a.rs"))) and not one(spark, text.is_test_file(F.lit("src/a.rs")))


def test_pass_at_k(spark):
    for (n, c, k), want in {(10, 0, 1): 0, (10, 10, 1): 1, (10, 5, 1): 0.5, (10, 5, 5): 0.9960317, (3, 0, 5): 1, (8, 1, 4): 0.5, (4, 2, 0): 0}.items():
        assert one(spark, stats.pass_at_k(F.lit(n), F.lit(c), F.lit(k))) == pytest.approx(want, abs=1e-6)


def test_wilson(spark):
    for (k, n), (low, high) in {(30, 100): (0.218948, 0.395850), (3, 10): (0.107789, 0.603227), (0, 10): (0, 0.277540), (10, 10): (0.722460, 1), (0, 0): (0, 0)}.items():
        got = one(spark, stats.wilson(F.lit(k), F.lit(n)))
        assert (got["low"], got["high"]) == (pytest.approx(low, abs=1e-6), pytest.approx(high, abs=1e-6))


def test_mcnemar(spark):
    def exact(b, c):
        n, m = b + c, min(b, c)
        return 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(m + 1)) / 2**n)

    rng = random.Random(1)
    cases = [(20, 0), (8, 3), (5, 5), (0, 0), (6, 0), (5, 0), (900, 1100), (2500, 2400), *((rng.randint(0, 60), rng.randint(0, 60)) for _ in range(30))]
    rows = spark.createDataFrame([(i, b, c) for i, (b, c) in enumerate(cases)], "i int, b long, c long")
    got = rows.select("i", stats.mcnemar_p(F.col("b"), F.col("c")).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == [pytest.approx(exact(b, c), rel=1e-8) for b, c in cases]
    assert one(spark, stats.detectable(F.lit(350))) == 14.98 and one(spark, stats.detectable(F.lit(100))) == 28.02


def test_perplexity(spark):
    rows = spark.createDataFrame([(2.0, 10), (1.0, 5), (9.0, 1)], "loss double, t long")
    assert rows.agg(stats.perplexity(F.col("loss"), F.col("t")).alias("x")).first()["x"] == pytest.approx(math.exp(22 / 13))
    assert rows.limit(0).agg(stats.perplexity(F.col("loss"), F.col("t")).alias("x")).first()["x"] == 1.0


RUST = """// File: a
#![allow(x)]
use std::fmt; // "fn no
/* fn /* nested */ { */
#[derive(Debug)]
pub struct A<'a> { x: &'a str, c: char }
const Q: &str = r#"fn f() { " }"#;
pub(crate) async fn go<'a>(x: &'a str) -> char {
    let c = '{'; let d = '\\''; let s = "}\\"{";
    if x.len() > 3 { return 'x'; }
    c // }
}
impl<'a> A<'a> { fn y(&self) {} }
mod tests;
enum E { A, B(u8) }
struct T(u8, [u8; 4]);
fn broken( {
"""


_SKIP = re.compile(r"""//[^\n]*|b?r(#*)".*?"\1|b?"(?:[^"\\]|\\.)*"|b?'(?:[^'\\\n]|\\.[^'\n]*)'|'[A-Za-z_]\w*|/\*""", re.S)
_WORD = re.compile(r"[A-Za-z_]\w*")
_BLOCK = re.compile(r"/\*|\*/")


def tokens(code):
    """(start, end, text) of words and of single signs; comments, strings and characters are left out, attributes come as one "#"."""
    at = 0
    while at < len(code):
        c = code[at]
        if c.isspace():
            at += 1
        elif (found := _SKIP.match(code, at)) is not None:
            at = _comment_end(code, at) if found[0] == "/*" else found.end()
        elif (found := _WORD.match(code, at)) is not None:
            yield at, found.end(), found[0]
            at = found.end()
        else:
            yield at, at + 1, c
            at += 1


def _comment_end(code, at):
    """Block comments nest."""
    depth = 0
    for found in _BLOCK.finditer(code, at):
        depth += 1 if found[0] == "/*" else -1
        if not depth:
            return found.end()
    return len(code)


def items_by_signs(code):
    """(start, end, bytes, kind) of the items at the top level, from their visibility on; attributes are not part of an item.

    An item ends at the brace that closes it, or at a semicolon outside of brackets. What is never closed is no item.
    """
    out, depth, start, kind, attribute = [], 0, None, None, False
    for begin, end, sign in tokens(code):
        if attribute:
            depth += sign in "[({"
            depth -= sign in "])}"
            attribute = depth > 0 or sign == "!"
            continue
        if start is None:
            if sign == "#":
                attribute = True
                continue
            start, kind = begin, None
        if kind is None and depth == 0 and sign in rust.KINDS:
            kind = sign
        if len(sign) == 1 and sign in "[({":
            depth += 1
        elif len(sign) == 1 and sign in "])}":
            depth = max(0, depth - 1)
        if depth == 0 and (sign == ";" or sign == "}"):
            if kind:
                out.append((start, end, len(code[start:end].encode("utf-8", "replace")), kind))
            start = None
    return out


PIECES = ["fn a() { x; }\n", "pub struct S;\n", "impl T for U { fn b(&self) -> &'static str { \"}\" } }\n", "// fn c() {}\n", "/* fn /* x */ { */\n", "#[derive(A, B(c))]\n", "#![allow(x)]\n", "enum E { A, B }\n"]
PIECES += ['r#"fn " {"#', 'b"x\\"y"', "'a'", "'\\n'", "b'\\''", "let é = 5;\n", "static X: [u8; 3] = [1, 2, 3];\n", "pub(crate) trait Tr { fn z(); }\n", "}", "{", ")", "; ", "const F: fn() = g;\n", "'life ", "\u3000", "mod m { fn q() {} }\n", "/*", "/", '"']
PIECES += ["async unsafe extern \"C\" fn w(x: &'a T) where T: Fn(u8) -> [u8; 2] {\n let c = '}';\n}\n", "macro_rules! m { ($x:expr) => { fn x() {} } }\n"]


def test_rust_items_as_sign_by_sign():
    rng = random.Random(1)
    for _ in range(10_000):
        code = "".join(rng.choices(PIECES, k=rng.randint(0, 12)))
        assert rust.items(code) == items_by_signs(code), code


def test_table_functions_in_lateral_joins(spark):
    rust.register(spark)
    spark.createDataFrame([(1, "fn a() {}\nstruct B;"), (2, None), (3, "nothing")], "i int, code string").createOrReplaceTempView("sources_of_code")
    rows = spark.sql("SELECT i, f.kind, f.source FROM sources_of_code, LATERAL rust_items(code) f ORDER BY i, f.start").collect()
    assert [tuple(r) for r in rows] == [(1, "fn", "fn a() {}"), (1, "struct", "struct B;")]
    manifest = '[package]\nname = "p"\n[dependencies]\na = "1"\np = "1"\n[dev-dependencies]\nb = { path = "x" }\na = "2"\n'
    spark.createDataFrame([(manifest,), ("broken [",), ("[dependencies]\na = 1",), (None,)], "m string").createOrReplaceTempView("some_manifests")
    assert sorted(tuple(r) for r in spark.sql("SELECT n.* FROM some_manifests, LATERAL package_needs(m) n").collect()) == [("p", "a"), ("p", "b")]


def test_rust_items(spark):
    found = [(kind, RUST[a:b]) for a, b, _, kind in rust.items(RUST)]
    assert [k for k, _ in found] == ["struct", "fn", "impl", "mod", "enum", "struct"]
    assert found[1][1].startswith("pub(crate) async fn go") and found[1][1].endswith("c // }\n}") and found[3][1] == "mod tests;"
    assert rust.items("") == [] and rust.items("fn") == [] and rust.items('"') == [] and rust.items("/* never closed fn a() {}") == []
    big = many(spark, lambda c: rust.middle(c), [RUST, "no items", "fn é() { \"é\" }\nfn b() { 1111 }\n", None])
    assert RUST[big[0]["start"] : big[0]["end"]] == found[1][1] and big[1] is None and big[3] is None and big[2]["start"] == 0
    assert many(spark, rust.functions_in, [RUST, None]) == [[found[1][1]], []]
    span = F.struct(F.lit(2).alias("start"), F.lit(5).alias("end"))
    assert one(spark, text.fim(F.col("t"), F.lit("psm"), span), t="abcdefghi") == "<|fim_prefix|>ab<|fim_suffix|>fghi<|fim_middle|>cde"


def test_scope(spark):
    cases = {"crates/a/src/x.rs": True, "crates/a/README.md": False, "docs/x.md": True, "a/crates/b.rs": False, "crates/x.rs": False, "x.rs": True}
    assert many(spark, text.in_scope, list(cases)) == list(cases.values())


def test_config(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1, "y": {"z": [1, 2], "w": {"v": true}}}')
    (tmp_path / "b.toml").write_text("[t]\nn = 3\n")
    assert config.flatten(config.load(str(tmp_path), "a")) == [("x", "1"), ("y.z", "[1, 2]"), ("y.w.v", "True")]
    assert config.load(str(tmp_path), "b.toml") == {"t": {"n": 3}}
    assert config.snapshot({"b": {"t": {"n": 3}}}, "cycle 1") == "== cycle 1 ==\n== b ==\nt.n = 3\n"
    assert [tuple(r) for r in config.settings_table(spark, {"a": {"y": {"z": 1, "e": {}}, "x": None}, "b": {}}).orderBy("place").collect()] == [("a", 0, "y.z", "1"), ("a", 1, "x", "None")]
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path), "none")


def test_settings_rows(spark, tmp_path):
    import json

    from tessera.sources import files

    rows = lambda *bodies, **more: sorted(tuple(r) for r in config.settings_rows(spark.createDataFrame([(f"c{i}", b) for i, b in enumerate(bodies)], "config string, body string"), **more).collect())
    nested = {"x": 1, "t": 'a"b', "e": {}, "y": {"z": [1, {"q": "é"}], "n": None, "w": {"v": True, "f": 1.5}}}
    assert rows(json.dumps(nested), None, "{}", "[1]") == [("c0", "t", 'a"b'), ("c0", "x", "1"), ("c0", "y.n", None), ("c0", "y.w.f", "1.5"), ("c0", "y.w.v", "true"), ("c0", "y.z", '[1,{"q":"é"}]'), ("c3", "", "[1]")]
    assert rows() == [] and len(rows('{"a": 1}', '{"a": 1}')) == 2
    for depth, broken, said in ((16, '{"a": ', "end-of-input"), (2, '{"a": {"b": {"c": 1}}}', "too many objects")):
        with pytest.raises(Exception, match=said):  # the session may wrap it
            rows(broken, depth=depth)
    assert rows('{"a": {"b": {"c": 1}}}', depth=3) == [("c0", "a.b.c", "1")]

    (tmp_path / "a.json").write_text('{"x": {"y": 1}}')
    (tmp_path / "b.v2.toml").write_text("[t]\nn = 3\nday = 2024-01-02\n")
    (tmp_path / "note.txt").write_text("not a setting")
    want = [("a", "x.y", "1"), ("b.v2", "t.day", "2024-01-02"), ("b.v2", "t.n", "3")]
    try:
        import yaml  # noqa: F401

        (tmp_path / "c.yaml").write_text("m:\n  lora: {r: 8}\n")
        (tmp_path / "d.yml").write_text("")
        want.append(("c", "m.lora.r", "8"))
    except ImportError:
        pass
    assert sorted(tuple(r) for r in config.settings_rows(files.configurations(spark, str(tmp_path))).collect()) == want
    for name in ("a.json", "b.v2.toml"):  # the same keys as on the driver
        stem = name.rpartition(".")[0]
        assert {k for k, _ in config.flatten(config.load(str(tmp_path), name))} == {k for c, k, _ in want if c == stem}


def test_token_capture(spark):
    from tessera.operators import chat

    kind = "array<struct<token_id:bigint,logprob:double>>"
    rows = spark.createDataFrame([([(5, -0.5), (None, -1.0), (7, None)],), ([],), (None,)], f"t {kind}").select(*chat.captured(F.col("t"))).collect()
    assert [list(r) for r in rows] == [[[5, -1, 7], [-0.5, -1.0, 0.0]], [[], []], [[], []]]
    lists = spark.createDataFrame([([[1, 2], None, [3]], [("assistant",), ("user",), ("assistant",)])], "t array<array<int>>, m array<struct<role:string>>")
    assert lists.select(chat.n_tokens(F.col("t")).alias("n"), chat.steps(F.col("m")).alias("s")).first() == (3, 2)
    flat = spark.createDataFrame([([[-1.0, -2.0], [], [-3.0]],), ([],)], "l array<array<double>>").select(stats.entropy_proxy(F.col("l")).alias("e"))
    assert [r.e for r in flat.collect()] == [2.0, 0.0]


def test_cost(spark):
    from tessera.operators import evaluation

    assert one(spark, evaluation.cost(F.col("m"), F.lit(2_000_000), {"api": 5.0}), m="api") == 10.0 and one(spark, evaluation.cost(F.col("m"), F.lit(9), {"api": 5.0}), m="own") == 0.0


def test_a_batch_of_sources_is_not_held_as_objects():
    import tracemalloc

    import pyarrow as pa

    source = RUST + "// é" + "x" * 8_000 + "\n"
    batch = pa.array([source, None, ""] * 500)
    tracemalloc.start()
    found = rust.top_level.func(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    own = [dict(zip(("start", "end", "bytes", "kind"), x, strict=True)) for x in rust.items(source)]
    assert found.to_pylist() == [own, [], []] * 500 and rust.top_level.func(pa.array([], pa.string())).to_pylist() == []
    assert peak < 2_000_000 < batch.nbytes / 2
