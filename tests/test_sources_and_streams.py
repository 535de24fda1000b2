"""Readers, writers and streams on small files."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tessera import folders
from tessera.operators import selection
from tessera.sources import files, sinks
from tessera.streaming import state, streams


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"task_id": "a", "x": 1, "extra": 2}\n\nnot json\n{"task_id": "b"}\n')
    rows = files.json_lines(spark, str(tmp_path / "a.jsonl"), "task_id string, x long")
    assert files.malformed(rows).first()["n_malformed"] == 1
    assert sorted(map(tuple, files.sound(rows.cache()).collect())) == [("a", 1), ("b", None)]
    assert files.json_lines(spark, str(tmp_path / "none.jsonl"), "x long").collect() == []
    sinks.json_lines(spark.range(3), str(tmp_path / "out"), compress=True)
    assert files.json_lines(spark, str(tmp_path / "out"), "id long", strict=True).count() == 3


def test_evaluation_ids(spark, tmp_path):
    (tmp_path / "t1.json").write_text(json.dumps({"task_id": "x"}, indent=1))
    (tmp_path / "t2.json").write_text("{}")
    ids = files.evaluation_ids(files.json_documents(spark, str(tmp_path), "task_id string"))
    assert sorted(r.task_id for r in ids.collect()) == ["t2", "x"]


def test_source_tree(spark, tmp_path):
    for name, content in {"crates/b/src/x.rs": "bee", "crates/a/y.rs": "ay", "docs/z.md": "zed", "crates/b/Cargo.toml": '[package]\nname="b"\n[dependencies]\na={}\nserde="1"\n', "crates/a/Cargo.toml": '[package]\nname="a"\n'}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    packages = files.manifests(spark, f"{tmp_path}/crates/*/Cargo.toml")
    assert {r.name: r.deps for r in packages.collect()} == {"a": [], "b": ["a"]}
    order = spark.createDataFrame([("a", 0), ("b", 1)], "name string, topo_rank long")
    rows = files.source_files(spark, str(tmp_path), ["crates/*.rs"], order=order).orderBy("topo_rank").collect()
    assert [(r.path, r.content) for r in rows] == [("crates/a/y.rs", "ay"), ("crates/b/src/x.rs", "bee")]


def test_logs(spark):
    lines = spark.createDataFrame([('{"type":"test","event":"ok","name":"a"}',), ("noise",), ('{"type":"suite","event":"ok"}',), ('{"type":"test","event":"started","name":"b"}',)], "value string")
    assert [tuple(r) for r in files.test_events(lines).collect()] == [("ok", "a")]
    log = spark.createDataFrame([("sha1\0subject\0body",), ("more body",)], "value string")
    assert [tuple(r) for r in files.commits(log).collect()] == [("sha1", "subject")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "cycle long, x string")
    sinks.shards(rows, str(tmp_path / "s"))
    sinks.shards(rows.where("cycle = 2").withColumn("x", F.lit("new")), str(tmp_path / "s"))
    assert sorted((r.cycle, r.x) for r in spark.read.json(str(tmp_path / "s")).collect()) == [(1, "a"), (2, "new")]
    sinks.replace_origin(rows, str(tmp_path / "o"))
    sinks.text_blocks(rows.select("x"), str(tmp_path / "t"))
    sinks.document(rows.limit(1), str(tmp_path / "d"))
    sinks.parquet(rows, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_state_over_batches(spark, tmp_path):
    kind = "task_id long, ord long, solved boolean"
    rows = [(t, i, (i * t) % 3 == 0) for t in (1, 2, 3) for i in range(14)]
    for n, part in enumerate((rows[::3], rows[1::3], rows[2::3])):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert n < 3
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    done = streams.finished(streams.newest_rates(source), "update")
    newest = done.groupBy("task_id").agg(F.max_by(F.struct("n", "solve_rate"), "batch_").alias("x")).select("task_id", "x.n", "x.solve_rate")
    batch = selection.recent_rates(spark.createDataFrame(rows, kind))
    assert sorted(map(tuple, newest.collect())) == sorted(map(tuple, batch.collect()))
    seen = streams.finished(streams.top_up(source.select("task_id"), "task_id"))
    assert sorted(r.task_id for r in seen.collect()) == [1, 2, 3]


def batches(spark, path, parts, kind):
    """A stream that reads each part in a micro-batch of its own, in their order."""
    for part in parts:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)


def test_metric_windows_over_batches(spark, tmp_path):
    """Events out of order between batches all count if the watermark allows for it; else it is an error."""
    import datetime as dt

    at = lambda hours: dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)
    parts = [[(at(9), "a", 1), (at(8.5), "a", 2)], [(at(1), "a", 4), (at(9.2), "b", 8)], [(at(30), "a", 16)], [(at(1.5), "a", 32)]]
    stream = batches(spark, str(tmp_path / "in"), parts, "ts timestamp, event_type string, value long")
    done = streams.finished(streams.metric_windows(stream, late="40 hours"), "update")
    newest = done.groupBy("window", "event_type").agg(F.max_by("total", "batch_").alias("total"), F.max_by("n", "batch_").alias("n"))
    assert sorted((r.total, r.n) for r in newest.collect()) == [(1, 1), (2, 1), (8, 1), (16, 1), (36, 2)]
    with pytest.raises(ValueError, match="later than the watermark"):
        streams.finished(streams.metric_windows(stream, late="1 hour"), "update")


def test_plateaus_over_batches(spark, tmp_path):
    parts = [[(1, 0, False), (1, 1, False), (2, 0, True)], [(1, 2, False), (2, 1, False)], [(2, 2, True), (3, 0, False)]]
    stream = batches(spark, str(tmp_path / "in"), parts, "run long, cycle long, promoted boolean")
    done = streams.finished(streams.plateaus(stream, patience=3), "update")
    newest = done.groupBy("run").agg(F.max_by(F.struct("cycle", "since", "stop"), "batch_").alias("x")).select("run", "x.*")
    assert sorted(map(tuple, newest.collect())) == [(1, 2, 3, True), (2, 2, 0, False), (3, 0, 1, False)]


def test_top_up_stops_at_its_target(spark, tmp_path):
    parts = [[(3, "a"), (1, "b"), (3, "c")], [(1, "d"), (2, "e"), (9, "f"), (8, "g")], [(5, "h")]]
    stream = batches(spark, str(tmp_path / "in"), parts, "k long, x string")
    assert sorted(r.k for r in streams.topped_up(stream, "k", 4).collect()) == [1, 2, 3, 8]
    assert sorted(r.k for r in streams.topped_up(stream, "k", 99).collect()) == [1, 2, 3, 5, 8, 9]


def test_readers_of_shards_and_ids(spark, tmp_path):
    import gzip

    (tmp_path / "ids/a").mkdir(parents=True)
    (tmp_path / "ids/a/x.jsonl").write_text('{"task_id": "t1"}\nbroken\n{"pr_number": 7}\n{"task_id": "", "pr_number": 0}\n')
    (tmp_path / "ids/y.jsonl").write_text('{"task_id": "t1", "pr_number": 9}\n')
    (tmp_path / "ids/z.txt").write_text('{"task_id": "t2"}\n')
    assert sorted(r.task_id for r in files.recursive_ids(spark, str(tmp_path / "ids")).collect()) == ["pr-7", "pr-9", "t1"]
    assert files.recursive_ids(spark, str(tmp_path / "none")).collect() == []
    (tmp_path / "c1.jsonl").write_text('{"x": 1}\n')
    with gzip.open(tmp_path / "c1.jsonl.gz", "wt") as f:
        f.write('{"x": 2}\n')
    (tmp_path / "c2.jsonl").write_text('{"x": 3}\n')
    assert [[r.x for r in files.shard(spark, str(tmp_path), n, "x long").collect()] for n in ("c1", "c2", "c3")] == [[2], [3], []]
    schema = files._schema("x long")
    for _ in range(2):
        assert files.json_lines(spark, str(tmp_path / "gone"), schema).columns == ["x", "_malformed"]
    assert schema.names == ["x"]


def test_cleaned(spark):
    with pytest.raises(KeyError), folders.cleaned(spark):
        outer, never = folders.work_folder(spark, "outer"), folders.work_folder(spark, "never")
        folders.written(spark.range(2), f"{outer}/x")
        with folders.cleaned(spark):
            inner = folders.work_folder(spark, "inner")
            folders.written(spark.range(2), f"{inner}/x")
        assert not folders.exists(spark, inner) and folders.exists(spark, outer)
        raise KeyError
    assert not folders.exists(spark, outer) and not folders.exists(spark, never)
    after = folders.work_folder(spark, "after")
    assert folders.written(spark.range(2), f"{after}/x").count() == 2 and folders.remove(spark, after)


def test_split_table(spark, tmp_path):
    from tessera.operators import corpus

    rows = spark.createDataFrame([(f"a/{i}.{'rs' if i % 3 else 'md'}", f"text {i} " * (i % 5)) for i in range(200)] + [("a/0.md", ""), (None, "x"), ("a/b.rs", None)], "path string, content string")
    sinks.split_table(rows, f"{tmp_path}/split")
    kind = "path string, training_content string"
    both = [sorted(map(repr, spark.read.schema(kind).json(f"{tmp_path}/split/held_out={side}").collect())) for side in ("false", "true")]
    assert both == [sorted(map(repr, x.collect())) for x in (corpus.samples(rows), corpus.held_out_samples(rows))] and all(both)


def test_work_folders(spark, tmp_path, monkeypatch):
    own = folders.work_folder(spark, "test")
    assert own.startswith("file:///") and folders.written(spark.range(2), f"{own}/x").count() == 2
    assert folders.remove(spark, own) and not folders.exists(spark, own)
    with pytest.raises(ValueError, match="not a work folder"):
        folders.remove(spark, str(tmp_path))
    for base, begins in ((str(tmp_path / "shared"), f"file://{tmp_path}/shared/tessera-test-"), ("hdfs://host/x/", "hdfs://host/x/tessera-test-")):
        with monkeypatch.context() as m:
            m.setattr(type(spark.conf), "get", lambda self, key, default=None, base=base: base)
            assert folders.work_folder(spark, "test").startswith(begins)
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    assert folders.work_folder(spark, "test").startswith("file:///")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        folders.work_folder(spark, "test")


def at(hours: float) -> datetime:
    return datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(hours=hours)


def in_batches(spark, place, schema, *parts):
    """A stream that gets each part in a batch of its own."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{place}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")


def test_windows_close_and_late_rows_are_put_beside_them(spark):
    place, kind = folders.work_folder(spark, "windows"), "ts timestamp, event_type string, value long"
    parts = [[(at(0.5), "a", 1), (at(0.6), "a", 2), (at(1.5), "b", 4)], [(at(3.5), "a", 8)], [(at(0.7), "a", 16), (at(3.6), "a", 32), (at(1.2), "b", 64), (at(9), "c", 128)]]
    found = state.windows(in_batches(spark, place, kind, *parts), "1 hour", 3_600_000)
    query = state.drained(spark, found.writeStream.format("parquet").option("path", f"{place}/out"), f"{place}/log")
    hour = lambda r: (r.ends - int(at(0).timestamp() * 1000)) // 3_600_000
    out = spark.read.schema(found.schema).parquet(f"{place}/out")
    assert sorted((r.event_type, hour(r), r.kind, r.n, r.total) for r in out.collect()) == [("a", 1, "closed", 2, 3), ("a", 1, "late", 1, 16), ("a", 4, "closed", 2, 40), ("b", 2, "closed", 1, 4), ("b", 2, "late", 1, 64)]
    open_ = state.state_table(spark, f"{place}/log", "sums")
    assert [(r.event_type, hour(r), r.n, r.total) for r in open_.collect()] == [("c", 10, 1, 128)]  # closed windows have left the state
    assert sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators) == 0
    assert {(r.event_type, hour(r)): (r.n, r.total) for r in state.corrected(out, open_).collect()} == {("a", 1): (3, 19), ("a", 4): (2, 40), ("b", 2): (2, 68), ("c", 10): (1, 128)}


def test_ids_are_forgotten_and_set_aside_when_they_return(spark):
    place, kind = folders.work_folder(spark, "once"), "k long, ts timestamp"
    parts = [[(i, at(0.1)) for i in range(60)] + [(1, at(0.2))], [(i, at(0.3)) for i in range(50, 70)], [(900, at(9))], [(901, at(20))], [(i, at(20.5)) for i in range(5)]]
    query = state.take_once(in_batches(spark, place, kind, *parts), "k", "ts", "1 hour", place)
    first, returned = state.taken(spark, place, kind, "k")
    assert sorted(r.k for r in first.collect()) == [*range(70), 900, 901]
    assert sorted((r.k, r.ts.hour) for r in returned.collect()) == [(i, 20) for i in range(5)]
    sizes = [s.numRowsTotal for p in query.recentProgress for s in p.stateOperators]
    assert max(sizes) >= 70 and sizes[-1] < 10


def test_state_is_a_table_and_goes_on_after_a_restart(spark):
    place, kind = folders.work_folder(spark, "newest"), "task_id long, ord long, solved boolean"
    rows = [(i % 3, i, i % 4 == 0) for i in range(90)]
    for part in (rows[50:], rows[:50]):
        state.keep_newest(in_batches(spark, place, kind, part), place)
        seen = spark.read.parquet(f"{place}/in")
        found = {tuple(r) for r in state.rates(state.state_table(spark, f"{place}/log", "newest")).collect()}
        assert found == {tuple(r) for r in selection.recent_rates(seen).select("task_id", "n", "solve_rate").collect()}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_settings_are_put_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(KeyError), state.settings(spark, {"spark.sql.shuffle.partitions": "3", "tessera.test": "1"}):
        assert spark.conf.get("tessera.test") == "1"
        raise KeyError
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get("tessera.test", None) is None


def test_top_up_takes_batch_by_batch(spark):
    place = folders.work_folder(spark, "topped")
    stream = in_batches(spark, place, "k long", [(5,), (4,), (5,)], [(1,), (4,), (9,)], [(0,)])
    assert sorted(r.k for r in streams.topped_up(stream, "k", 3).collect()) == [1, 4, 5]


def test_runs_of_tests(spark):
    event = lambda kind, what, **more: json.dumps({"type": kind, "event": what, **more})
    out = "\n".join([event("test", "ok", name="a"), "   Compiling", event("suite", "ok"), event("test", "failed", name="b"), event("test", "ok"), event("test", "started", name="c")])
    rows = [(1, 101, out, "ignored"), (2, 101, "x" * 600 + "end", ""), (3, 1, "said", "e" * 10), (4, 0, None, None), (5, None, out, "slow"), (6, 2, None, None)]
    found = {r.run: (r.exit_code, r.passed, r.failed, r.error) for r in files.test_runs(spark.createDataFrame(rows, "run int, exit_code int, stdout string, stderr string")).collect()}
    assert found == {1: (101, ["a", "?"], ["b"], None), 2: (101, [], [], "x" * 497 + "end"), 3: (1, [], [], "e" * 10), 4: (0, [], [], None), 5: (-1, [], [], "timed out"), 6: (2, [], [], "")}


def test_a_text_file_has_its_own_name(spark, tmp_path):
    for text in ("old", "new"):
        sinks.text_file(spark.createDataFrame([(f"{text} {i}",) for i in range(3)], "v string").coalesce(1), f"{tmp_path}/a/b/x.rs")
    assert (tmp_path / "a/b/x.rs").read_text() == "new 0\nnew 1\nnew 2\n" and [p.name for p in (tmp_path / "a/b").iterdir() if p.suffix == ".rs"] == ["x.rs"]
    with pytest.raises(FileNotFoundError):
        folders.moved(spark, f"{tmp_path}/none-*", f"{tmp_path}/y")
