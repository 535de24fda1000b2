"""Operators whose results fixed code can tell: top-k, packing, media, substrings, near duplicates, against brute force."""

import hashlib
import io
import random
import tarfile
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.folders import work_folder
from tessera.llm import common, media, neardup, packing, substrings, topk, words


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


DOC = "doc_id long, text string, kind string, component_id string, raw string, items string, n string"


def docs_frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, "x", "y", "z", None, "0") for d, t in rows], DOC).repartition(3)


ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "one"), (6, "One  two"), (6, "One  two"), (7, "é 😀 ß" * 5), (8, "a " * 3000), (9, "x" * 50_000)]


def near_brute(rows, k):
    def items(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = {d: items(t) for d, t in rows if d is not None}
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return sorted((d, len(items(t)), root(d), root(d) == d) for d, t in rows if d is not None)


def near_corpus(seed, n=60):
    rng = random.Random(seed)
    rows, d = list(ODD), 100
    for _ in range(n):
        words = prose(rng, rng.randint(8, 120)).split()
        rows.append((d, " ".join(words)))
        d += 1
        for _ in range(rng.choice([0, 0, 1, 2, 12])):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 12))):
                own[rng.randrange(len(own))] = f"n{rng.randint(0, 10**6)}"
            rows.append((d, " ".join(own)))
            d += 1
    return rows


@pytest.mark.parametrize(("k", "limit"), [(2, 20_000), (5, 20_000), (2, 60)])
def test_near_duplicates(spark, k, limit):
    rows = near_corpus(k + limit)
    got = neardup.near_duplicates(docs_frame(spark, rows), k=k, node_limit=limit).collect()
    assert sorted(tuple(r) for r in got) == near_brute(rows, k)


@pytest.mark.parametrize(("cap", "dense", "block"), [(1, 16, 512), (8, 1, 512), (0, 0, 3), (1, 2, 4)])
def test_near_duplicates_dense_groups_meet_in_blocks(spark, monkeypatch, cap, dense, block):
    """Classes that are close to many meet a whole label, or each other in cells, with the same result."""
    monkeypatch.setattr(neardup, "CAP", cap)
    monkeypatch.setattr(neardup, "DENSE", dense)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = near_corpus(9, 25)
    got = neardup.near_duplicates(docs_frame(spark, rows), k=2).collect()
    assert sorted(tuple(r) for r in got) == near_brute(rows, 2)


@pytest.mark.parametrize("levels", [0, 12])
def test_near_duplicates_groups_beyond_the_node_limit(spark, monkeypatch, levels):
    """Near copies that no branching parts, more than a node may hold, beside others; also with blocks on both sides."""
    monkeypatch.setattr(neardup, "LEVELS", levels)
    rng = random.Random(levels)
    rows = []
    for g in range(3):
        own = prose(rng, 400, 10**6).split()
        for i in range(150):
            copy = list(own)
            copy[rng.randrange(400)] = f"n{g}x{i}"
            if i % 10 == 0:
                for _ in range(rng.choice([15, 25, 40, 80])):
                    copy[rng.randrange(400)] = f"m{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, t) for i, (_, t) in enumerate(near_corpus(3, 20))]
    got = neardup.near_duplicates(docs_frame(spark, rows), k=2, node_limit=40).collect()
    assert sorted(tuple(r) for r in got) == near_brute(rows, 2)


def boilerplate_sets(rng, n, planted, shared, own=100):
    """n sets that share items, the first of them in pairs that are 0.80 to 0.85 alike."""
    common, out = rng.integers(0, 2**64, shared, dtype=np.uint64), []
    for i in range(planted):
        both = rng.integers(0, 2**64, own, dtype=np.uint64)
        new = int((shared + own) * (0.081 + 0.03 * i / planted))  # (1 - new) / (1 + new) of the size
        out += [np.concatenate([common, both]), np.concatenate([common, both[new:], rng.integers(0, 2**64, new, dtype=np.uint64)])]
    out += [np.concatenate([common, rng.integers(0, 2**64, own, dtype=np.uint64)]) for _ in range(n - 2 * planted)]
    return out


@pytest.mark.parametrize("shared", [60, 700])
def test_near_duplicates_pairs_within_boilerplate(monkeypatch, shared):
    """Links near 0.8 among classes that many levels of branching part, or none, are met in one of the trees."""
    monkeypatch.setattr(neardup, "LEAF", 8)
    sets = boilerplate_sets(np.random.default_rng(1), 600, 150, shared)
    sketch, roots = neardup.sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    wanted = {(i + 1, i) for i in range(0, 300, 2) if neardup.similar(np.sort(sets[i]), np.sort(sets[i + 1]), 80) and (sketch[i] == sketch[i + 1]).sum() >= 90}
    found = set()
    for tree in range(neardup.TREES):
        for node in np.unique(roots[:, tree]):
            ids = np.flatnonzero(roots[:, tree] == node)
            columns = [pa.array([int(node)] * len(ids)), pa.array(ids), pa.array(ids), common.binary_array(sketch[ids].ravel(), np.arange(len(ids) + 1) * neardup.PLACES)]
            batch = pa.RecordBatch.from_arrays(columns, names=["node", "doc_id", "label", "sketch"])
            for out in neardup._pairs(0.8)(iter([batch])):
                assert 1 not in out["kind"].to_pylist()
                cells = {}
                for b, a, kind in zip(*(out[c].to_pylist() for c in ("b", "a", "kind")), strict=True):
                    if kind == 0:
                        found.add((b, a))
                    else:
                        cells.setdefault(a, []).append(b)
                found.update((max(x, y), min(x, y)) for own in cells.values() for x in own for y in own if x != y)
    assert len(wanted) > 100 and not wanted - found


def test_near_duplicates_with_a_low_estimate(spark):
    """Links at exactly 0.8 whose sketches happen to agree in few places are found too."""
    texts = [" ".join(f"p{i}x{j}" for j in part) for i in range(10_000) for part in (range(45), [*range(40), *range(50, 55)])]
    raw = [t.encode() for t in texts]
    g, at = neardup.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 1)
    sketch, _ = neardup.sketches(g, at)
    low = np.flatnonzero((sketch[::2] == sketch[1::2]).sum(1) < 87)
    rows = [(int(2 * i + j), texts[2 * i + j]) for i in low for j in range(2)]
    got = neardup.near_duplicates(docs_frame(spark, rows), k=1).collect()
    assert len(low) and sorted(tuple(r) for r in got) == near_brute(rows, 1)


def test_near_duplicates_compares_places():
    rng = np.random.default_rng(2)
    for n, m in [(1, 1), (3, 5), (70, 90)]:
        a, b = (rng.integers(0, 2, (rows, neardup.PLACES), dtype=np.uint8) for rows in (n, m))
        b[0] = a[0]
        assert (neardup.equal_places(a, b) == (a[:, None] == b[None]).sum(-1)).all()


def test_near_duplicates_null_id_and_empty(spark):
    got = neardup.near_duplicates(docs_frame(spark, [(None, "a b c"), (3, "a b c"), (None, "q r s")])).collect()
    assert sorted((r.doc_id is None, r.component_id or -1, r.kept) for r in got) == [(False, 3, True), (True, -1, False), (True, 3, False)]
    assert neardup.near_duplicates(docs_frame(spark, [])).collect() == []


def substring_brute(rows, window):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(d, least.get(key, d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("window", "group"), [(13, 1_000_000), (13, 40), (4, 40), (8, 1)])
def test_remove_repeats(spark, window, group):
    rng = random.Random(window + group)
    passages = [prose(rng, rng.randint(5, 40)) for _ in range(6)]
    rows = [r for r in ODD if r[0] != 6]
    for d in range(100, 160):
        rows.append((d, " \n".join(rng.choice([prose(rng, rng.randint(0, 30), 2000), rng.choice(passages)]) for _ in range(5))))
    got = substrings.remove_repeats(docs_frame(spark, rows), window=window, group_windows=group, with_text=True)
    assert sorted(tuple(r)[:4] for r in got.collect()) == substring_brute(rows, window)
    assert got.where(F.sha2("kept_text", 256) != F.col("kept_sha256")).isEmpty()
    assert substrings.remove_repeats(docs_frame(spark, [])).collect() == []


def test_remove_repeats_without_id(spark):
    text = prose(random.Random(1), 30)
    got = substrings.remove_repeats(docs_frame(spark, [(None, text), (None, text), (5, text), (4, text)])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (-1, 0), (4, 0), (5, 30)]


@pytest.mark.parametrize("turns", [1_000_000, 30])
def test_remove_repeats_with_hashes_that_collide(spark, monkeypatch, turns):
    """Whatever hashes say, words decide: here a word's hash has 3 bits."""
    real = words.names
    monkeypatch.setattr(words, "names", lambda *a, **b: words.mix(real(*a, **b) & np.uint64(7)))
    rng = random.Random(turns)
    passages = [prose(rng, 20) for _ in range(4)]
    rows = [(i, " ".join([prose(rng, rng.randint(0, 12), 40), rng.choice(passages), prose(rng, rng.randint(0, 12), 40)])) for i in range(60)]
    raw = [(d, t.encode()) for d, t in rows]
    data, offsets = np.frombuffer(b"".join(t for _, t in raw), np.uint8), np.cumsum([0, *(len(t) for _, t in raw)])
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in raw]), common.binary_array(data, offsets), pa.array([0] * len(raw))], names=["doc_id", "raw", "sum"])
    cells = substrings.CELLS
    shipped = [(g, b) for k in (0, 30) for part in substrings._ship(13, np.zeros(cells, np.int64), np.ones(cells, np.int64), np.zeros(cells, bool))(iter([batch.slice(k, 30)])) for g, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
    marks = [r for part in substrings._mark(13, turns)(iter([pa.RecordBatch.from_arrays([pa.array([g for g, _ in shipped]), pa.array([b for _, b in shipped])], names=["grp", "blob"])])) for r in part.to_pylist()]
    gone = {d: set() for d, _ in rows}
    for r in marks:
        gone[r["doc_id"]].update(range(r["first"], r["first"] + r["n"] + 12))
    assert [(d, len(gone[d])) for d, _ in rows] == [(x[0], x[2]) for x in substring_brute(rows, 13)]


def test_many_windows_of_one_landmark_are_told_apart():
    """Five million different windows, half a million in a group, all of one landmark: none is a repeat; a planted one is."""
    rng, found, planted = np.random.default_rng(4), 0, 0
    letters = np.frombuffer(b"abcdefghijklmnop", np.uint8)
    for part in range(10):
        n = 500_000
        text = np.full((n, 13, 5), 32, np.uint8)
        text[:, :, :4] = letters[rng.integers(0, 16, (n, 13, 4))]
        text[:, 5:8, :4] = np.frombuffer(b"zzzzyyyyxxxx", np.uint8).reshape(3, 4)
        if part == 9:
            text[7] = text[3]
            planted = 1
        stretches = b"\n".join(x.tobytes() for x in text)
        meta = [np.diff(np.arange(n), prepend=0), np.zeros(n, np.int64), np.diff(np.arange(n), prepend=0), np.zeros(n, np.int64), np.ones(n, np.int64)]
        found += len(substrings.repeats([substrings._pack(meta, stretches)], 13)[0])
    assert (found, planted) == (1, 1)


@pytest.mark.parametrize("limit", [50, 300])
def test_remove_repeats_of_long_texts_by_pieces(spark, monkeypatch, limit):
    """Texts that are longer than a chunk are worked on in pieces, with the same result."""
    rng = random.Random(limit)
    shared = prose(rng, 60)
    rows = [(1, prose(rng, 400)), (2, prose(rng, 90) + " " + shared + "\t" + prose(rng, 100)), (3, shared + "  " + prose(rng, 200) + " " + shared), (4, "x" * 1000 + " " + shared), (5, "y" * 900), (6, "")]
    rows += [(7, rows[0][1]), (8, "  " + rows[1][1])]
    raw = [(d, t.encode()) for d, t in rows]
    monkeypatch.setattr(substrings, "CHUNK_BYTES", limit)
    shipped, gone = [], {d: [] for d, _ in rows}
    for d, t in raw:
        batch = pa.RecordBatch.from_arrays([pa.array([d]), pa.array([t]), pa.array([0])], names=["doc_id", "raw", "sum"])
        cells = substrings.CELLS
        for part in substrings._ship(13, np.zeros(cells, np.int64), np.ones(cells, np.int64), np.zeros(cells, bool))(iter([batch])):
            shipped += zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
    shipped.sort(key=lambda x: x[0])
    for part in substrings._mark(13, 10**6)(iter([pa.RecordBatch.from_arrays([pa.array([g for g, _ in shipped]), pa.array([b for _, b in shipped])], names=["grp", "blob"])])):
        for r in part.to_pylist():
            gone[r["doc_id"]].append((r["first"], r["n"]))
    got = []
    for d, t in raw:
        lists = [pa.array([[x[i] for x in gone[d]]], pa.list_(pa.int64())) for i in (0, 1)]
        batch = pa.RecordBatch.from_arrays([pa.array([d]), pa.array([t]), *lists], names=["doc_id", "raw", "first", "n"])
        got += [tuple(r.values()) for part in substrings._kept(13, True)(iter([batch])) for r in part.to_pylist()]
    assert sorted(r[:4] for r in got) == substring_brute(rows, 13)
    assert all(hashlib.sha256(r[4].encode()).hexdigest() == r[3] for r in got)


def test_repeated_passages(spark):
    rng = random.Random(6)
    a, b = prose(rng, 30, 10**6), prose(rng, 20, 10**6)
    rows = [(1, f"{a} x {b}"), (2, f"q {a} r {b}"), (3, f"{prose(rng, 40, 10**6)} {b[3:]}"), (2, f"q {a} r {b}"), (None, a)]
    got = substrings.repeated_passages(docs_frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == [(2, 1, 30), (2, 32, 20), (3, 41, 19)]
    assert substrings.repeated_passages(docs_frame(spark, [])).collect() == []


def test_plan_splits_common_prefixes_only(monkeypatch):
    monkeypatch.setattr(substrings, "GROUPS_EACH", 4)
    counts = np.array([5, 5, 1000, 0, 7, 3])
    first, parts, common = substrings.plan(counts, 3)
    assert parts.tolist() == [1, 1, 12, 1, 1, 1] and common.tolist() == [False, False, True, False, False, False]
    assert first[0] == first[1] and first[4] == first[5] and first[4] >= first[2] + 12
    even = substrings.plan(np.full(64, 1000), 64)  # more groups than cells: landmarks are split, and no cell is common
    assert even[1].tolist() == [4] * 64 and not even[2].any()


@pytest.mark.parametrize("cells", [1, 12])
def test_remove_repeats_with_a_common_phrase(spark, monkeypatch, cells):
    """Windows that share all but one word with thousands of others aren't taken for repeats, in common cells or not; real ones are found."""
    if cells == 1:
        monkeypatch.setattr(substrings, "COMMON", 10**9)
    rng = random.Random(cells)
    phrase = " ".join(f"p{i}" for i in range(12))
    texts = [f"{prose(rng, 7, 10**9)} {phrase} {prose(rng, 7, 10**9)}" for _ in range(30_000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(30_000 + i, "other " + texts[i]) for i in range(0, 30_000, 1000)]
    got = substrings.remove_repeats(docs_frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(tuple(r) for r in got) == substring_brute(rows, 13)


def test_media_round_trip(spark):
    rows = [*ODD, (10, "a" * 192), (11, "a" * 193)]
    got = media.media_columns(docs_frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.width, r.height, r.bits, r.channels) == (zlib.crc32(payload[-16:]), 64, len(payload) // 192, 8, 3)
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    assert media.media_columns(docs_frame(spark, [])).collect() == []


def test_media_headers_and_shards(spark):
    folder = work_folder(spark, "test")
    rows = [(i, f"text {i % 4} " * 50) for i in range(12)]
    references = media.store(docs_frame(spark, rows).coalesce(1), folder)
    assert references.select("shard", "offset").distinct().count() == 4
    assert media.catalog(references).count() == 4
    assert {r.height for r in media.metadata(references, folder).collect()} == {-(-len(rows[0][1]) // 192)}
    store, path = media._open(f"{folder}/shards")
    for shard in {r.shard for r in references.collect()}:
        with store.open_input_file(f"{path}/{shard}") as file, tarfile.open(fileobj=io.BytesIO(file.read())) as tar:
            for member in tar:
                image = tar.extractfile(member).read()
                assert member.name.endswith(hashlib.sha256(media.from_png(image)).hexdigest() + ".png")


def test_encoder_is_the_tokenizers(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        encode, own = packing.encoder(path), Tokenizer.from_file(path)

        @settings(max_examples=300, deadline=None)
        @given(st.text(max_size=80))
        def same(text):
            assert encode(text).tolist() == own.encode(text, add_special_tokens=False).ids  # noqa: B023

        same()
        assert encode("a<|endoftext|> b").tolist() == own.encode("a<|endoftext|> b", add_special_tokens=False).ids


def check_packing(pieces, lengths):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length))
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert p.doc_tokens == lengths[p.doc_id] and p.length > 0
    assert set(by_doc) == set(lengths)
    for d, own in by_doc.items():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at == lengths[d]
    padding = 0
    for own in by_seq.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding


def test_packer_is_exact():
    rng = np.random.default_rng(5)
    for n in (0, 1, 3, 400):
        packer = packing.Packer(2)
        lengths = {}
        for d in range(n):
            lengths[d] = int(rng.choice([1, 2, 100, 128, 700, 1024, 5000]) * rng.uniform(0.5, 1)) + 1
            packer.add(d, rng.integers(0, 50_000, lengths[d]).astype(np.uint32))
        rows = packer.rows(last=True)
        pieces = [type("P", (), r) for r in rows.to_pylist()] if rows else []
        assert check_packing(pieces, lengths) < 1024


def test_packer_bounds_what_it_holds_and_fills_step_groups(monkeypatch):
    """Long documents leave at once; every step group of a task but the last is full, over many packs and all lengths."""
    monkeypatch.setattr(packing, "HELD", 5000)
    rng, packer, lengths, rows = np.random.default_rng(8), packing.Packer(0, step_tokens=8192), {}, []
    for d in range(600):
        lengths[d] = int(rng.choice([3, 90, 130, 700, 102_401 if d % 40 == 0 else 1500])) + int(rng.integers(0, 60))
        packer.add(d, rng.integers(0, 50_000, lengths[d]).astype(np.uint32))
        waiting = sum(len(p[3]) for own in packer.waiting.values() for _, pieces in own for p in pieces)
        assert packer.held < 5000 + 1024 and waiting < 1024
        if len(packer.out) > 200:
            rows += packer.rows().to_pylist()
    rows += packer.rows(last=True).to_pylist()
    assert check_packing([type("P", (), r) for r in rows], lengths) < 1024
    tokens = {}
    for g, t in {(r["step_group"], r["sequence_id"]): r["tier"] for r in rows}.items():
        tokens[g[0]] = tokens.get(g[0], 0) + t
    assert len(tokens) > 30 and all(n == 8192 for g, n in tokens.items() if g != max(tokens)) and tokens[max(tokens)] <= 8192 + 1024


def test_long_texts_are_encoded_in_pieces(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(2)
    text = "".join(rng.choice(["a", "word", " ", "  ", "\n", "'s", "é", "東", "9", ".", " \x1c", "\x85 "]) for _ in range(3000))
    whole = packing.encoder(path)(text)
    monkeypatch.setattr(packing, "PIECE_CHARS", 40)
    assert len(list(packing.text_pieces(text))) > 20 and packing.encoder(path)(text).tolist() == whole.tolist()


def test_pack_documents(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [r for r in ODD if r[0] != 6] + [(100 + i, prose(random.Random(i), 50 * i)) for i in range(20)]
    encode = packing.encoder(path)
    ids = {d: np.append(encode(t or ""), np.uint32(0)) for d, t in rows}
    pieces = packing.pack(docs_frame(spark, rows), path).collect()
    check_packing(pieces, {d: len(x) for d, x in ids.items()})
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].astype("<u4").tobytes())
    assert packing.pack(docs_frame(spark, [(1, "a"), (1, "a"), (None, "b")]), path).count() >= 3
    assert packing.pack(docs_frame(spark, []), path).collect() == []


def top_brute(rows, k, mod):
    good = [(i, v, [int(np.floor(64 * np.float64(np.float32(x)))) for x in e]) for i, (v, e) in enumerate(rows) if v is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, v, e in good:
        if v % mod == 0:
            best = sorted((-sum(a * b for a, b in zip(e, f)), w) for j, w, f in good if j != i)[:k]
            out += [(v, n + 1, w, -s) for n, (s, w) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 3])
def test_top_k(spark, block):
    rng = np.random.default_rng(block)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(80)]
    rows += [(100 + i, [0.5] * 6) for i in range(40)]
    rows += [(None, [1.0] * 6), (200, None), (201, [None] * 6), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, []), (205, [1.0, 2.0])]
    frame = spark.createDataFrame([(v, e, 1, "q") for v, e in rows], "vec_id long, embedding array<float>, rid long, score string").repartition(3)
    got = topk.top_k(frame, k=7, scale=64, query_mod=5, query_block=block).collect()
    assert sorted(tuple(r) for r in got) == top_brute(rows, 7, 5)


def test_top_k_few_and_none(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(frame([(0, [1.0]), (1, [1.0]), (0, [2.0])]), k=5, scale=64, query_mod=20).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 0, 8192), (0, 1, 0, 8192), (0, 2, 1, 4096), (0, 2, 1, 8192)]
    assert topk.top_k(frame([]), k=5, scale=64, query_mod=20).collect() == []
    assert topk.top_k(frame([(1, [1.0])]), k=5, scale=64, query_mod=20).collect() == []


def test_names_of_words(monkeypatch):
    """Equal words have equal names wherever they are, others don't; words of any length."""
    rng = random.Random(8)
    monkeypatch.setattr(words, "LONG_NAME", 24)
    own = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(3000)] + [b"a" * n for n in range(1, 300)]
    text = b" ".join(own)
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = words.split(data, np.array([0, len(data)]))
    names = words.names(data, starts, ends).tolist()
    assert len(names) == len(own) and len(set(zip(names, own, strict=True))) == len(set(names)) == len(set(own))


def test_words_split_like_bytes():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab É\t\n\x0b\x1c 9") for _ in range(rng.randint(0, 20))).encode() for _ in range(200)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    starts, ends, before = words.split(data, offsets)
    own = [[bytes(data[s:e]) for s, e in zip(starts[a:b], ends[a:b])] for a, b in pairwise(before)]
    assert own == [t.split() for t in texts]


def _blob(text: bytes, doc: int, n: int = 1, single: bool = True) -> bytes:
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = words.split(data, np.array([0, len(data)]))
    return substrings._packed(text, starts, ends, np.array([0]), np.array([n]), np.array([doc]), np.array([0]), np.array([0]), 13, single)


def _met(blobs: list[bytes], group_windows: int, slots: int, fan: int) -> tuple[list, dict]:
    """Marks, and blobs by finer group, of one large group."""
    rows = sorted((i % slots, b) for i, b in enumerate(blobs))
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(rows)), pa.array([b for _, b in rows], pa.binary()), pa.array([s for s, _ in rows])], names=["grp", "blob", "slot"])
    marks, finer = [], {}
    for part in substrings._meet(13, group_windows, np.array([slots]), np.array([fan]))(iter([batch])):
        for row in part.to_pylist():
            if row["grp"] is None:
                marks += [(row["doc_id"], row["first"] + i) for i in range(row["n"])]
            else:
                finer.setdefault(row["grp"], []).append(row["blob"])
    return marks, finer


def test_a_window_of_many_documents_is_reduced_before_it_meets():
    blobs = [_blob(b" ".join(b"w%d" % i for i in range(13)), doc) for doc in range(1, 2001)]
    marks, finer = _met(blobs, 100, 20, 1)
    rest = [b for own in finer.values() for b in own]
    assert len(rest) <= 40 and all(substrings.windows_of(b) <= 1 for b in rest)
    last = substrings.repeats(rest, 13)
    assert sorted([d for d, _ in marks] + last[0].tolist()) == list(range(2, 2001))


def test_a_large_group_is_spread_over_finer_ones():
    rng = random.Random(11)
    texts = [b" ".join(b"x%d" % rng.randrange(10**6) for _ in range(112)) for _ in range(60)]
    texts += [texts[i] for i in range(0, 60, 4)]
    blobs = [_blob(t, i, n=100, single=False) for i, t in enumerate(texts)]
    marks, finer = _met(blobs, 500, 15, 15)
    assert len(finer) > 10 and max(sum(map(substrings.windows_of, own)) for own in finer.values()) < 1500
    for own in finer.values():
        d, _, s, n = substrings.repeats(own, 13)
        marks += [(a, b + i) for a, b, k in zip(d.tolist(), s.tolist(), n.tolist(), strict=True) for i in range(k)]
    assert sorted(marks) == [(60 + i, j) for i in range(15) for j in range(100)]


def test_two_texts_of_one_doc_id_do_not_mix(spark):
    base, other = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, base), (2, base + " x x"), (2, "y " + other), (3, other)]
    got = {(r.doc_id, r.n_words): r.n_removed for r in substrings.remove_repeats(docs_frame(spark, rows)).collect()}
    assert got == {(1, 40): 0, (2, 42): 40, (2, 41): 0, (3, 40): 40}
