import json
import time

import pytest
from pyspark.sql import functions as F

from trailhead import session
from trailhead.operators import skew
from trailhead.session import settle
from trailhead.sources import events, files as SF, index_store


def test_read_files(spark, tmp_path):
    root = tmp_path / "repos"
    for name, body in {
        "r1/src/a.py": b"import x\n", "r1/env/pyvenv.cfg": b"home", "r1/env/lib/z.py": b"z", "r1/node_modules/q.js": b"q",
        "r1/bad.md": b"ok\xff\xfetext", "r1/skip.txt": b"no", "r2/big.py": b"from a import (\n  b,\n)\n" + b"x = 1\n" * 5000 + b"    import late\n",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    got = {(r.repo, r.path): r for r in SF.read_files(spark, str(root), 16_000).collect()}
    assert set(got) == {("r1", "src/a.py"), ("r1", "bad.md"), ("r2", "big.py")}
    assert got["r1", "bad.md"].content == "oktext" and got["r1", "bad.md"].kind == "doc"
    big = got["r2", "big.py"]
    assert len(big.content) == 16000 and big.import_source == "from a import (\n  b,\n)\nimport late"
    assert got["r1", "src/a.py"].import_source == ""


def test_log_reading(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    rows = [{"event_type": "x", "event_time": t, "path": p} for t, p in (("2024-01-01T00:00:00Z", "a"), ("2024-02-01T00:00:00Z", "b"))]
    log.write_text("\n".join([json.dumps(rows[0]), "", "{broken", json.dumps(rows[1]), json.dumps({"event_type": "y", "path": "c"})]))
    assert [(r.seq, r.path) for r in events.read_events(spark, str(log)).orderBy("seq").collect()] == [(0, "a"), (3, "b"), (4, "c")]
    assert {r.path for r in events.read_events(spark, str(log), since="2024-01-15T00:00:00Z").collect()} == {"b", "c"}
    with pytest.raises(Exception):
        events.read_telemetry(spark, str(log)).select("event_type", "op").collect()


def test_event_defaults_are_only_filled_in(spark):
    df = spark.createDataFrame([("x", None), ("y", 7)], "event_type string, schema_version int")
    got = {r.event_type: r for r in events.with_event_defaults(df).collect()}
    assert got["x"].schema_version == 1 and got["y"].schema_version == 7 and got["x"].event_time is not None


def test_index_version_gate(spark, tmp_path):
    chunks = spark.createDataFrame([("a.py", 0), ("a.py", 1)], "path string, chunk_index int")
    index_store.save_index(chunks, str(tmp_path / "i"), "m", 4, {"target_tokens": 400})
    assert index_store.load_index(spark, str(tmp_path / "i")).count() == 2
    meta = index_store.load_meta(spark, str(tmp_path / "i"))
    assert meta.first().entry_count == 2 and meta.first().file_count == 1
    assert index_store.compatible(meta, "m", {"target_tokens": 400}).first().compatible
    assert not index_store.compatible(meta, "m2", {"target_tokens": 400}).first().compatible
    with pytest.raises(index_store.IndexVersionError):
        index_store.load_index(spark, str(tmp_path / "i"), expect_version=3)


def wide_index(spark, path, n=10_000, buckets=256):
    chunks = spark.range(n).select(
        F.lit("r").alias("repo"), F.format_string("src/f%05d.py", "id").alias("path"), F.lit(0).cast("long").alias("chunk_index"),
        F.concat(F.lit("h"), "id").alias("content_hash"))
    index_store.save_index(chunks, path, "m", 4, {"t": 1}, buckets=buckets)
    return chunks


def named(spark, numbers, **more):
    rows = [("r", f"src/f{i:05d}.py", 0, f"new{i}") for i in numbers]
    return spark.createDataFrame(rows, "repo string, path string, chunk_index long, content_hash string")


def test_an_update_rewrites_the_buckets_of_its_paths_only(spark, tmp_path):
    path = str(tmp_path / "i")
    wide_index(spark, path)
    before = {r.bucket: (r.folder, r.entries) for r in index_store.manifest(spark, path)}
    reader = index_store.load_index(spark, path)
    updates = named(spark, [*range(0, 1000, 111)])
    assert updates.count() == 10
    assert index_store.upsert_index(spark, path, updates) == 1
    after = {r.bucket: (r.folder, r.entries) for r in index_store.manifest(spark, path)}
    changed = {b for b in after if after[b] != before[b]}
    assert 0 < len(changed) <= 10 and len({after[b][0] for b in changed}) == 1
    written = sum(p.stat().st_size for b in changed for p in (tmp_path / "i/chunks" / after[b][0]).rglob("*.parquet"))
    assert len(list((tmp_path / "i/chunks" / after[min(changed)][0]).glob("bucket=*"))) == len(changed) and written
    # A reader that began before sees what it began with, a new one sees the update.
    assert reader.where("content_hash like 'new%'").count() == 0 and reader.count() == 10_000
    now = index_store.load_index(spark, path)
    assert now.count() == 10_000 and sorted(r.content_hash for r in now.where("content_hash like 'new%'").collect()) == sorted(r.content_hash for r in updates.collect())
    assert index_store.delete_from_index(spark, path, updates.where("content_hash <> 'new0'")) == 2
    assert index_store.load_index(spark, path).count() == 9_991 and index_store.load_meta(spark, path).first().file_count == 9_991
    assert index_store.load_index(spark, path, version=0).where("content_hash like 'new%'").count() == 0
    assert index_store.upsert_index(spark, path, named(spark, [20_000])) == 3 and index_store.load_meta(spark, path).first().entry_count == 9_992
    assert index_store.upsert_index(spark, path, updates.limit(0)) == 3


def test_a_failed_update_leaves_the_last_version(spark, tmp_path):
    path = str(tmp_path / "i")
    wide_index(spark, path, 100, 8)
    broken = lambda part: part.withColumn("content_hash", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        index_store.update_index(spark, path, named(spark, [1]), broken)
    with pytest.raises(ValueError, match="not named"):
        index_store.update_index(spark, path, named(spark, [1]).limit(1), lambda part: part.unionByName(named(spark, range(200, 260))))
    assert index_store.latest_version(spark, path) == 0 and index_store.load_index(spark, path).count() == 100

    def meanwhile(part):
        index_store.delete_from_index(spark, path, named(spark, [5]))
        return part

    with pytest.raises(index_store.IndexConflictError):
        index_store.update_index(spark, path, named(spark, [1]), meanwhile)
    assert index_store.latest_version(spark, path) == 1 and index_store.load_index(spark, path).count() == 99
    # The index may be written from itself, and old folders go.
    assert index_store.save_index(index_store.load_index(spark, path).where("path > 'src/f00049.py'"), path, "m", 4, buckets=8) == 2
    assert len(index_store.vacuum(spark, path, keep=1)) == 4
    assert index_store.load_index(spark, path).count() == 50
    with pytest.raises(FileNotFoundError):
        index_store.load_index(spark, path, version=0)
    with pytest.raises(FileNotFoundError):
        index_store.load_index(spark, str(tmp_path / "none"))


def test_content_is_processed_once_and_given_back(spark):
    files = spark.createDataFrame([("r", "a", "x"), ("r", "b", "x"), ("s", "a", "y")], "repo string, path string, content string")
    once = SF.dedupe_content(files)
    assert once.count() == 2 and {r.path for r in once.collect()} == {"a"}
    back = SF.reattach_content(files, once.select("content_sha", F.length("content").alias("n")))
    assert {(r.repo, r.path) for r in back.collect()} == {("r", "a"), ("r", "b"), ("s", "a")}


def test_percentiles_of_a_hot_key(spark):
    rows = [("hot", v) for v in range(1, 5001)] + [("b", 7), ("b", 10)] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = {r.k: (r.p50, r.p95, r.max, r.n) for r in skew.exact_percentiles(df, ["k"], ["v"], width=64).collect()}
    assert got == {"hot": (2500, 4750, 5000, 5000), "b": (8, 7, 10, 2)}


def test_salted_join_equals_a_plain_join(spark):
    big = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(tuple, big.join(small, "k", how).select("k", "id").collect()))
        assert plain == sorted(map(tuple, skew.salted_join(big, small, ["k"], ["id"], how).select("k", "id").collect()))


def test_dense_offsets(spark):
    got = skew.dense_offsets(spark.range(0, 100, 1, 7)).orderBy("id").collect()
    assert [r.seq for r in got] == list(range(100))


def test_stored_tables_leave_no_shuffle_files(spark):
    """A table that was written needs its shuffle no more: the files go, though the plan is still held; the session's setting stays."""
    def files():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (held.apply(i).getName() for i in range(held.size())) if name.startswith("shuffle_")}

    before, setting = files(), spark.conf.get(session.DROP_SHUFFLES, None)
    counted = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    tables = [settle(counted) for _ in range(2)]
    late = time.monotonic() + 10
    while files() - before and time.monotonic() < late:
        time.sleep(0.1)
    assert not files() - before
    assert all(t.selectExpr("sum(count)").first()[0] == 1000 for t in tables)
    assert spark.conf.get(session.DROP_SHUFFLES, None) == setting
