"""Operators 11 to 13 against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import clusters, divergence, factors, queries

TEXTS = "doc_id long, text string"


def removed_by_loops(rows, length, first_stays, order):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of rows (doc_id, text); order tells where a text comes among those of one doc_id."""
    raw = [(text or "").encode() for _, text in rows]
    place = lambda i, s: (rows[i][0] is not None, rows[i][0] or 0, order[rows[i][1] or ""], s)
    found: dict[bytes, list] = {}
    for i, b in enumerate(raw):
        for s in range(len(b) - length + 1):
            found.setdefault(b[s : s + length], []).append((i, s))
    out = []
    for i, b in enumerate(raw):
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            others = found[b[s : s + length]]
            if place(i, s) > min(place(*x) for x in others) if first_stays else len(others) > 1:
                gone[s : s + length] = b"\1" * length
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((rows[i][0], len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def planted_rows(seed: int):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcé ") for _ in range(rng.randint(1, 200))) for _ in range(10)]
    part = lambda: rng.choice(passages)[rng.randint(0, 40) :][: rng.randint(0, 150)] if rng.random() < 0.4 else "".join(rng.choice("abcdefgh\0") for _ in range(rng.randint(0, 80)))
    rows = [(rng.choice([None, i, i]), "".join(part() for _ in range(rng.randint(0, 6))) if rng.random() < 0.95 else None) for i in range(100)]
    rows += [(500, "x" * 300), (501, "x" * 300), (501, "x" * 300), (None, "x" * 200)]
    noise = lambda: "".join(rng.choice("pqrs") for _ in range(30))
    return rows + [(600 + i, noise() + passages[0] * 2 + noise()) for i in range(50)]  # one passage among many contexts


@pytest.mark.parametrize(("seed", "length", "hot"), [(1, 5, 256), (2, 12, 8), (3, 20, 256), (4, 40, 8)])
def test_repeated_bytes_go_as_by_loops(spark, seed, length, hot):
    rows = planted_rows(seed)
    docs = spark.createDataFrame([(i, "other", t, 1) for i, t in rows], "doc_id long, raw string, text string, id int").repartition(5)
    order = {r.text or "": r.h for r in docs.selectExpr("text", "xxhash64(cast(coalesce(text, '') as binary)) AS h").collect()}
    for first_stays in (False, True):
        found = factors.remove_repeated_bytes(docs, length, first_stays=first_stays, hot=hot).collect()
        assert sorted((tuple(r) for r in found), key=str) == removed_by_loops(rows, length, first_stays, order)


def test_spans_and_kept_bytes_fit_together(spark):
    rows = [(i, t) for i, (_, t) in enumerate(planted_rows(7))]
    docs = spark.createDataFrame(rows, TEXTS)
    kept = {r.doc_id: bytes(r.kept) for r in factors.remove_repeated_bytes(docs, 20, with_text=True).collect()}
    spans: dict[int, list] = {}
    for r in factors.repeated_spans(docs, 20).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.n_bytes))
    for i, t in rows:
        b = bytearray((t or "").encode())
        for start, n in sorted(spans.get(i, []), reverse=True):
            del b[start : start + n]
        assert kept[i] == bytes(b)


def test_later_copies_go_and_the_first_stays(spark):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(500))
    noise = lambda: "".join(rng.choice("0123456789") for _ in range(300))
    docs = spark.createDataFrame([(i, noise() + passage + noise()) for i in range(40)], TEXTS)
    gone = {r.doc_id: r.n_removed for r in factors.remove_repeated_bytes(docs, 400, hot=4).collect()}
    assert gone[0] == 0 and all(gone[i] >= 500 for i in range(1, 40))


def test_repeats_in_one_long_text(spark, monkeypatch):
    """A text of several pieces; a repeat lies across their border."""
    rng = np.random.default_rng(5)
    text = "".join(map(chr, rng.integers(97, 123, 2_500_000)))
    text = text[: (1 << 20) - 250] + text[:600] + text[(1 << 20) - 250 :]
    row = factors.remove_repeated_bytes(spark.createDataFrame([(1, text)], TEXTS), 400, first_stays=False).first()
    assert (row.n_bytes, row.n_spans) == (len(text), 2) and 1200 <= row.n_removed <= 1210
    assert row.kept_sha256 != hashlib.sha256(text.encode()).hexdigest()


def test_repeats_of_short_null_and_no_texts(spark):
    assert factors.remove_repeated_bytes(spark.createDataFrame([], TEXTS), 400).collect() == []
    empty = hashlib.sha256(b"").hexdigest()
    rows = factors.remove_repeated_bytes(spark.createDataFrame([(1, None), (2, ""), (3, "a" * 399), (3, "a" * 399), (None, "a" * 399)], TEXTS), 400, first_stays=False).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in rows) == [(0, 0, 0)] * 2 + [(399, 0, 0)] * 3
    assert sum(r.kept_sha256 == empty for r in rows) == 2
    with pytest.raises(ValueError):
        factors.remove_repeated_bytes(spark.createDataFrame([], TEXTS), 0)


def test_passages_of_over_fifty_words_go_from_400_bytes_on(spark, tmp_path):
    """Each passage of 51 words is in two documents between different separators; what tells that it was caught is n_removed, n_bytes is the whole length."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows, gone = [], {}
    for size in (330, 399, 400, 401, 600):
        letters, more = divmod(size - 50, 51)
        passage = " ".join(word(letters + (i < more)) for i in range(51))
        assert len(passage) == size
        for between in " \n":
            gone[len(rows)] = size if size >= 400 else 0
            rows.append((len(rows), between.join([*(word(7) for _ in range(30)), passage, *(word(7) for _ in range(30))])))
    for _ in range(10):  # clean ones
        gone[len(rows)] = 0
        rows.append((len(rows), " ".join(word(7) for _ in range(100))))
    spark.createDataFrame(rows, TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.QUERIES["op11_suffix_array_dedup"](spark, str(tmp_path)).collect()}
    assert {i: r.n_removed for i, r in found.items()} == gone
    assert {i: r.n_bytes for i, r in found.items()} == {i: len(t) for i, t in rows}
    assert all(r.n_spans == (r.n_removed > 0) for r in found.values())


def test_anchors_are_shared_by_equal_strings():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 6000).astype(np.uint8)
    data[4000:5000] = data[1000:2000]
    first, n, gram, _ = factors.stretches(data, np.array([0, 2500, 6000]), 300)
    at = dict(zip(np.concatenate([np.arange(f, f + k) for f, k in zip(first, n, strict=True)]).tolist(), np.repeat(gram, n).tolist(), strict=True))
    assert sorted(at) == [*range(2201), *range(2500, 5701)]  # every suffix once
    assert all(at[1000 + i] == at[4000 + i] for i in range(701))


WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def divergence_by_loops(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(source, Counter(WORD.findall(text.translate(LOW)))) for text, one, source in rows if one == lang]
        docs = Counter(t for _, c in own for t in c)
        kept = [t for t, n in docs.items() if n >= least]
        counts: dict[str, Counter] = {}
        for source, c in own:
            counts.setdefault(source, Counter()).update({t: n for t, n in c.items() if t in kept})
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + Fraction(10**9 * (c[t] + 5), c.total() + 5 * len(kept)).__floor__() for t in kept}
        q, shares = share(whole), {s: share(c) for s, c in counts.items()}
        for s, p in shares.items():
            pairs = sorted((-sum(abs(p[t] - o[t]) for t in kept), x.encode(), x) for x, o in shares.items() if x != s)
            terms = sorted((q[t] - p[t], t.encode(), t) for t in kept if counts[s][t] and p[t] > q[t])[:top]
            out += [(lang, s, part, x, -v, i) for part, found in (("pair", pairs), ("term", terms)) for i, (v, _, x) in enumerate(found, 1)]
    return sorted(out)


def test_divergence_as_by_loops(spark):
    rng = random.Random(8)
    vocabulary = ["Aa", "aA", "b", "été", "ÉTÉ", "word", "x", "中文", "ﬁ", "İ", "zz", "rare"]
    text = lambda: rng.choice([" ", "-", "1", "\n"]).join(rng.choices(vocabulary, [9, 1, 5, 3, 2, 8, 4, 2, 1, 1, 1, 0.05], k=rng.randint(0, 40)))
    rows = [(rng.choice([text(), text(), None]), rng.choice(["en", "en", "de", None, "fr"]), rng.choice(["s1", "s1", "s1", "s2", "é", None, "S9"])) for _ in range(200)]
    rows += [("only numbers 12"[10:], "en", "bare"), ("b " * 500, "en", "s1"), ("q", "xx", "alone"), (None, "yy", "a"), (None, "yy", "b")]
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, n int, term string").repartition(6)
    found = divergence.divergence(docs, least_docs=5, top=4).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, found)) == divergence_by_loops(rows, 5, 4)
    assert any(r.lang == "yy" and r.value == 0 for r in found)


def test_divergence_of_nothing_and_of_a_long_text(spark):
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
    words = " ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(2_000_000))
    rows = [(words, "en", "a"), ("wak wbk", "en", "b"), ("wak", "en", "b")]
    found = divergence.divergence(spark.createDataFrame(rows, "text string, lang string, source string"), least_docs=2, top=3).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in found) == divergence_by_loops(rows, 2, 3)


def test_tallies_are_the_joint_histogram():
    rng = np.random.default_rng(2)
    cells = sorted({(int(t), int(g)): int(n) for t, g, n in zip(rng.integers(0, 300, 2000), rng.integers(0, 9, 2000), rng.integers(1, 4, 2000), strict=True)}.items())
    term, group, n = (np.array(c) for c in ([t for (t, _), _ in cells], [g for (_, g), _ in cells], [n for _, n in cells]))
    of: dict[int, list] = {}
    for (t, g), c in cells:
        of.setdefault(t, []).append((g, c))
    expected = Counter((a, b, ca, cb) for own in of.values() for i, (a, ca) in enumerate(own) for b, cb in own[i + 1 :])
    found: Counter = Counter()
    for rows, m in divergence.tallied(term, group, n):
        found.update(dict(zip(zip(*(r.tolist() for r in rows), strict=True), m.tolist(), strict=True)))
    assert found == expected


def clusters_by_loops(rows, k, rounds, dim):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    starts = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in starts]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for i in range(rounds + 1):
        at = [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if i < rounds:
            for j in range(len(centroids)):
                if own := [v for (_, v), (_, a) in zip(kept, at, strict=True) if a == j]:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inertia = Counter()
    for d, j in at:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], inertia.total(), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, at, strict=True)), key=str)


@pytest.mark.parametrize("size", [1, 0.02, 1e9])
def test_clusters_as_by_loops(spark, size):
    """Small whole numbers make many ties."""
    rng = np.random.default_rng(int(size) % 97)
    rows = [(int(i) if i % 9 else None, [float(x) for x in rng.integers(-3, 4, 5) * size / (1 if size < 1e6 else 1e5)]) for i in range(300)]
    rows += [(7, rows[8][1])] * 3 + [(400, None), (401, []), (402, [1.0] * 4), (403, [1.0] * 6), (404, [1.0, None, 1.0, 1.0, 1.0]), (405, [float("nan")] * 5), (406, [float("inf")] * 5)]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance double").repartition(4)
    found = clusters.centroid_clusters(df, k=6, rounds=3, dim=5).collect()
    assert sorted((tuple(r) for r in found), key=str) == clusters_by_loops(rows, 6, 3, 5)


def test_numbers_beyond_a_long_on_the_way():
    rng = np.random.default_rng(6)
    x, c = rng.integers(-(2**50), 2**50, (200, 4)), rng.integers(-(2**50), 2**50, (5, 4))
    at, best, upper, lower, _ = clusters.assign(x, c, None, np.zeros(200), np.zeros((200, 5)), np.zeros(5), True)
    nearest = [min((sum((int(p) - int(q)) ** 2 for p, q in zip(v, w, strict=True)), j) for j, w in enumerate(c)) for v in x]
    assert list(zip(best.tolist(), at.tolist(), strict=True)) == nearest
    assert all(u * u >= d for u, (d, _) in zip(upper.tolist(), nearest, strict=True))


def test_bounds_save_distances_and_change_nothing(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 20, (8, 16))
    rows = [(i, (centres[i % 8] + rng.normal(0, 1, 16)).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    state, _ = clusters.clustered(df, k=8, rounds=3, dim=16)
    calculated = state.agg({"calculated": "sum"}).first()[0]
    assert calculated < 0.6 * 800 * 8 * 4
    found = clusters.centroid_clusters(df, k=8, rounds=3, dim=16).collect()
    assert sorted((tuple(r) for r in found), key=str) == clusters_by_loops(rows, 8, 3, 16)


def test_clusters_of_few_or_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert clusters.centroid_clusters(spark.createDataFrame([], kind)).collect() == []
    assert clusters.centroid_clusters(spark.createDataFrame([(1, None)], kind)).collect() == []
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert sorted((tuple(r) for r in clusters.centroid_clusters(spark.createDataFrame(rows, kind)).collect()), key=str) == clusters_by_loops(rows, 16, 3, 64)
