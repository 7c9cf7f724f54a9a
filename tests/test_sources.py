"""Readers: defaults, quarantine of malformed lines, request payloads."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.sources import io as IO
from tessera.sources.versions import Conflict, VersionedTable
from tessera.storage import scratch_path
from tessera.streaming.streams import tail_run_logs


def test_read_pairs_defaults_and_corrupt(spark, tmp_path):
    d = str(tmp_path)
    with open(os.path.join(d, "a.jsonl"), "w") as fh:
        fh.write('{"pair_id": 1, "query": "q1", "sql": "SELECT 1"}\n')
        fh.write("\n")
        fh.write('{"pair_id": 2, "query": "q2", "sql": \n')
        fh.write('{"pair_id": 3, "query": "q3", "sql": "SELECT 3", "difficulty": "hard", "domain": "x"}\n')
    good, bad = IO.split_corrupt(IO.read_pairs(spark, d))
    rows = {r.pair_id: r for r in good.collect()}
    assert set(rows) == {1, 3}
    assert rows[1].difficulty == "medium" and rows[1].domain == "general" and rows[1].reasoning == ""
    assert rows[3].difficulty == "hard"
    assert bad.count() == 1


def test_read_requests_object_or_list(spark):
    df = spark.createDataFrame([(1, '{"query": "a"}'), (2, '[{"query": "b", "context": "c"}, {"query": "d"}]')],
                               "id int, payload string")
    rows = sorted((r.id, r.query, r.context) for r in IO.read_requests(df).collect())
    assert rows == [(1, "a", ""), (2, "b", "c"), (2, "d", "")]


def test_scratch_folder_is_shared_and_removable(spark):
    import os

    import pytest

    from tessera import session, storage
    df = storage.written(spark.range(3), "three")
    assert df.count() == 3 and os.path.isdir(storage.scratch_root(spark))

    class Cluster:  # a session on a cluster that names no shared folder
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Cluster)


@pytest.mark.parametrize("split_bytes", [None, 700])
def test_lines_of_malformed_pairs(spark, tmp_path, split_bytes):
    """At one split a file and at many, with blank lines, CR LF and a last line without an end."""
    want = set()
    for f in range(3):
        with open(tmp_path / f"f{f}.jsonl", "w", newline="") as fh:
            for line in range(1, 400):
                if line % 7 == f:
                    text = ""
                elif line % 11 == f or line == 399:
                    text = '{"pair_id": %d, "query": ' % line
                    want.add((f"f{f}.jsonl", line, text))
                else:
                    text = '{"pair_id": %d, "query": "é%s"}' % (line, "x" * (line % 50))
                fh.write(text + ("" if line == 399 else "\r\n" if line % 5 == 0 else "\n"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split_bytes:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = IO.malformed_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {(r.source_file.rsplit("/", 1)[1], r.line, r.raw) for r in found} == want and len(found) == len(want)


def test_a_tail_gives_each_event_once(spark):
    root = scratch_path(spark, "tail-test")

    def page(rows):
        spark.createDataFrame(rows, IO.LOG_SCHEMA).coalesce(1).write.mode("append").json(f"{root}/logs")

    def poll(**kw):
        return sorted(tuple(r) for r in tail_run_logs(spark, f"{root}/logs", f"{root}/state", **kw).select(
            "run_id", "timestamp", "message", "next_cursor").collect())

    page([("a", 5, "x"), ("b", 7, "y")])
    page([("a", 9, "z")])
    tail = tail_run_logs(spark, f"{root}/logs", f"{root}/state", page_files=1)
    assert sorted({r.page for r in tail.collect()}) == [0, 1] and tail.count() == 3
    assert poll() == []
    page([("a", 9, "same time"), ("a", 3, "late"), ("c", 1, "new")])
    assert poll(page_files=1) == [("a", 3, "late", 10), ("a", 9, "same time", 10), ("c", 1, "new", 2)]
    assert poll() == []


def test_table_versions(spark):
    rows = spark.createDataFrame([(1, 5.0, "a"), (2, None, "b"), (3, 7.0, None)], "id long, v double, s string")
    table = VersionedTable.create(rows, scratch_path(spark, "versions"))
    assert table.update(F.col("v") > 6, {"s": F.lit("big")}) == 1
    assert table.insert([{"id": 4, "v": 1.0, "s": "d"}]) == 2
    assert table.delete(F.col("v") < 6) == 3

    def at(n=None):
        return sorted((tuple(r) for r in table.read(n).collect()), key=lambda r: r[0])

    assert at(0) == [(1, 5.0, "a"), (2, None, "b"), (3, 7.0, None)]
    assert at(1) == [(1, 5.0, "a"), (2, None, "b"), (3, 7.0, "big")]
    assert [r[0] for r in at(2)] == [1, 2, 3, 4] and [r[0] for r in at()] == [2, 3]
    assert [r.operation for r in table.history().orderBy("version").collect()] == ["create", "update", "insert", "delete"]
    # a reader that began before a change keeps its rows
    held = table.read()
    table.overwrite(rows.limit(0))
    assert held.count() == 2 and table.read().count() == 0
    with pytest.raises(ValueError):
        table.read(9)


def test_a_failed_write_is_invisible(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 2)], "id long, v long")
    table = VersionedTable.create(rows, scratch_path(spark, "failed"))
    with pytest.raises(Exception):
        table.overwrite(rows.withColumn("v", F.raise_error("lost").cast("long")))
    assert table.version() == 0 and table.read().collect() == rows.collect()
    # the rows are written, the manifest isn't
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        table.overwrite(rows)
    monkeypatch.undo()
    assert table.version() == 0 and table.overwrite(rows) == 1


def test_of_two_writers_one_is_told(spark):
    rows = spark.createDataFrame([(1, 2)], "id long, v long")
    table = VersionedTable.create(rows, scratch_path(spark, "conflict"))
    results = []
    for _ in range(2):  # both have seen version 0
        try:
            results.append(table._commit(rows, "overwrite", 1))
        except Conflict:
            results.append("told")
    assert table.version() == 1 and table.read().count() == 1 and 1 in results
    assert table.history().count() == 2


def test_a_folders_files_count_as_one_text(spark, tmp_path):
    good, bad = '{"pair_id":1,"query":"q","sql":"s"}', '{"pair_id":2,"que'
    for folder, files in (("part=0", [[good, bad], [bad], [good, "", bad]]), ("part=1", [[bad], [good, bad]])):
        (tmp_path / folder).mkdir()
        for n, lines in enumerate(files):
            (tmp_path / folder / f"part-{n:05d}.txt").write_text("\n".join(lines) + "\n")
    found = IO.malformed_lines(spark, f"{tmp_path}/part=*", folders=True).collect()
    assert sorted((r.source_file.split("/")[-2], r.line) for r in found) == [
        ("part=0", 2), ("part=0", 3), ("part=0", 6), ("part=1", 1), ("part=1", 3)]
