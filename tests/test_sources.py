"""Sources, sinks and streams."""

import datetime
import hashlib

import pytest

from quarry.operators import members
from quarry.__main__ import main
from quarry.sources import files, snapshots
from quarry.streaming import jobs


def test_files_and_archive_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.tar").write_bytes(members.pack_tar([("x", b"one"), ("y", b"two")]))
    (tmp_path / "in/b.bin").write_bytes(b"plain")
    rows = files.contents(spark, str(tmp_path / "in"), "*.bin")
    assert [bytes(r.content) for r in rows.collect()] == [b"plain"] and files.contents(spark, str(tmp_path / "in"), max_bytes=5).count() == 1
    files.register_sources(spark)
    got = spark.read.format("archive").option("path", str(tmp_path / "in")).load()
    assert sorted((r.name, bytes(r.content)) for r in got.collect()) == [("x", b"one"), ("y", b"two")]
    got.select("name", "content").coalesce(1).write.format("archive").option("path", str(tmp_path / "out")).option("kind", "zip").mode("append").save()
    back = spark.read.format("archive").option("path", str(tmp_path / "out")).load()
    assert sorted((r.name, bytes(r.content)) for r in back.collect()) == [("x", b"one"), ("y", b"two")]


def test_failed_archives_leave_nothing(spark, tmp_path):
    files.register_sources(spark)
    rows = spark.createDataFrame([("a", bytearray(b"1")), ("b", None)], "name string, content binary").repartition(2, "name")
    with pytest.raises(Exception):
        rows.write.format("archive").option("path", str(tmp_path / "out")).mode("append").save()
    assert not list((tmp_path / "out").glob("*.tar"))
    rows.where("content is not null").write.format("archive").option("path", str(tmp_path / "fine")).option("kind", "tar_gz").mode("append").save()
    assert [f.name.split(".", 1)[1] for f in (tmp_path / "fine").iterdir()] == ["tar_gz"]


def test_snapshots_stay(spark, tmp_path):
    rows = spark.createDataFrame([(1, bytearray(b"0123456789")), (2, bytearray(b"01"))], "id long, content binary")
    path = str(tmp_path / "s")
    snapshots.persist(snapshots.ranges_of(rows, "id", [(2, 3), (0, 2), (-1, 2)]), path)
    assert sorted((r.id, r.offset, bytes(r.content)) for r in snapshots.opened(spark, path).collect()) == [(1, 0, b"01"), (1, 2, b"234"), (2, 0, b"01")]
    with pytest.raises(Exception, match="(?i)exist"):
        snapshots.persist(rows, path)


def test_console(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.tar").write_bytes(members.pack_tar([("x", b"one")]))
    assert main(["list", str(tmp_path / "in")], spark) == 0 and "TAR" in capsys.readouterr().out
    assert main(["test", str(tmp_path / "in")], spark) == 0
    assert main(["extract", str(tmp_path / "in"), "--out", str(tmp_path / "out")], spark) == 0 and spark.read.parquet(str(tmp_path / "out")).count() == 1
    broken = bytearray(members.pack_zip([("a", b"abc" * 50)]))
    broken[33] ^= 0xFF
    (tmp_path / "in/b.zip").write_bytes(broken)
    assert main(["test", str(tmp_path / "in")], spark) == 1
    with pytest.raises(SystemExit) as wrong:
        main(["extract", "x"], spark)
    assert wrong.value.code == 2


def test_sub_views(spark):
    rows = spark.createDataFrame([(1, 2, bytearray(b"abcd")), (2, -1, bytearray(b"abcd")), (3, 2, bytearray(b"abcd"))], "offset int, size int, content binary")
    assert [r.content and bytes(r.content) for r in files.sub_views(rows).orderBy("offset").collect()] == [b"bc", b"cd", None]


def _stream(spark, tmp_path, schema, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"src/{k}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "src/*"))


def _run(spark, df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_window_stream_equals_batch(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(k, t + datetime.timedelta(minutes=17 * k), k % 3, "abc"[k % 2], float(k)) for k in range(40)]
    schema = "event_id long, ts timestamp, user_id int, event_type string, value double"
    stream = _stream(spark, tmp_path, schema, [rows[:20], rows[20:]])
    got = _run(spark, jobs.tumbling_counts(stream), tmp_path, "windows", "update")
    final = {}
    for r in got:
        final[(r.start, r.event_type)] = max(final.get((r.start, r.event_type), (0, 0.0)), (r.n, r.total))
    want = {(r.start, r.event_type): (r.n, r.total) for r in jobs.tumbling_counts(spark.createDataFrame(rows, schema)).collect()}
    assert final == want


def test_chunked_contents(spark, tmp_path):
    whole = {k: bytes(range(32, 127)) * 3 + b"\0" + k.encode() * 10 for k in ("a", "b")}
    chunks = [(k, i, bytearray(d[i * 50 : i * 50 + 50]), (i + 1) * 50 >= len(d)) for k, d in whole.items() for i in range(-(-len(d) // 50))]
    schema = "key string, chunk int, content binary, last boolean"
    stream = _stream(spark, tmp_path, schema, [chunks[::2], chunks[1::2]])
    got = _run(spark, jobs.chunk_digests(stream), tmp_path, "digests", "append")
    assert {r.key: (r.size, r.sha256) for r in got} == {k: (len(d), hashlib.sha256(d).hexdigest()) for k, d in whole.items()}
    found = jobs.chunk_strings(spark.createDataFrame(chunks, schema), 8).collect()
    assert sorted((r.key, r.text) for r in found) == sorted((k, t) for k, d in whole.items() for t in (bytes(range(32, 127)).decode() * 3, k * 10))
