from __future__ import annotations

import numpy as np
import pytest

from cartoquill.sources import binary, stores, tsv


def test_tsv(spark, tmp_path):
    (tmp_path / "poi.txt").write_text(" Cafe, North \t1.5\t2\nbroken line\nPark\t3\t4\n")
    (tmp_path / "q.txt").write_text("Cafe north\t1\t2\t0,2\nx\t1\t1\t\n")
    assert [tuple(r) for r in tsv.read_poi(spark, str(tmp_path / "poi.txt")).orderBy("poi_id").collect()] == [(0, "cafe, north", 1.5, 2.0), (2, "park", 3.0, 4.0)]
    q = tsv.read_queries(spark, str(tmp_path / "q.txt"))
    assert [tuple(r) for r in q.orderBy("query_id").collect()] == [(0, "cafe north", 1.0, 2.0, [0, 2]), (1, "x", 1.0, 1.0, [])]
    tsv.write_queries(q, str(tmp_path / "out"))
    assert q.exceptAll(tsv.read_queries(spark, str(tmp_path / "out"))).isEmpty()
    with pytest.raises(Exception):
        tsv.read_poi(spark, str(tmp_path / "poi.txt"), strict=True).collect()


def test_line_numbers_of_a_split_file(spark, tmp_path):
    (tmp_path / "l.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = tsv.numbered_lines(spark, str(tmp_path / "l.txt"))
        assert rows.rdd.getNumPartitions() > 1
        assert all(r["line"] == f"line {r['line_no']}" for r in rows.collect()) and rows.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_passages(spark, tmp_path):
    (tmp_path / "p.tsv").write_text('id\ttext\ttitle\n1\t"A text"\tT\n')
    assert [tuple(r) for r in tsv.read_passages(spark, str(tmp_path / "p.tsv")).collect()] == [(1, "A text", "T")]


@pytest.mark.parametrize("with_truths", [False, True])
def test_dataset_files_are_read_in_ranges(spark, tmp_path, monkeypatch, with_truths):
    """No task decodes a whole file: each range of rows is a batch of its own."""
    monkeypatch.setattr(binary, "ROWS", 7)
    lists = [[(i * k) % 997 for k in range(i % 5)] for i in range(100)]
    truths = [list(range(i % 4)) for i in range(100)] if with_truths else None
    (tmp_path / "d.bin").write_bytes(binary.encode_dataset(lists, [(i, -i) for i in range(100)], truths, 1000))
    read = binary.read_dataset(spark, str(tmp_path / "d.bin"))
    got = sorted(read.collect())
    assert [(r["id"], r["bits"], r["x"], r["y"], r["truths"]) for r in got] == [(i, lists[i], float(i), float(-i), truths[i] if truths else []) for i in range(100)]
    assert read.rdd.getNumPartitions() > 1
    rows = spark.createDataFrame([(r["id"], r["bits"], r["x"], r["y"], r["truths"]) for r in got], read.schema)
    binary.write_dataset(rows, str(tmp_path / "e.bin"), 1000, with_truths)
    assert (tmp_path / "e.bin").read_bytes() == (tmp_path / "d.bin").read_bytes()


def test_binary_round_trips(spark, tmp_path):
    (tmp_path / "d.bin").write_bytes(binary.encode_dataset([[1, 5], [], [7]], [(1, 2), (3, 4), (5, 6)], [[2], [], [0, 1]], 64))
    rows = binary.read_dataset(spark, str(tmp_path / "d.bin")).orderBy("id").collect()
    assert [(r["bits"], r["x"], r["truths"]) for r in rows] == [([1, 5], 1.0, [2]), ([], 3.0, []), ([7], 5.0, [0, 1])]
    assert binary.decode_dataset(binary.encode_dataset([], [])).empty
    (tmp_path / "tree.bin").write_bytes(binary.encode_tree([[[0, 2], [1]], [[0, 1]]]))
    assert [tuple(r) for r in binary.read_tree(spark, str(tmp_path / "tree.bin")).collect()] == [(0, 0, 0, 0), (0, 0, 1, 2), (0, 1, 0, 1), (1, 0, 0, 0), (1, 0, 1, 1)]
    n = np.arange(64).reshape(2, 32)
    assert (binary.decode_nodes(binary.encode_nodes(n), 2) == n).all()
    with pytest.raises(ValueError):
        binary.decode_nodes(b"1234", 2)
    (tmp_path / "c.bin").write_bytes(binary.encode_candidates([np.array([[1], [2]]), np.array([[3, 4], [5, 6]])]))
    last = binary.read_candidates(spark, str(tmp_path / "c.bin"), [1, 2], only_last=True)
    assert sorted(map(tuple, last.collect())) == [(0, 1, 1, 3), (0, 1, 2, 4), (1, 1, 1, 5), (1, 1, 2, 6)]
    assert len(binary.decode_candidates((tmp_path / "c.bin").read_bytes(), [1, 2])) == 6


def test_npy_shards(spark, tmp_path):
    for k, m in ((10, [[5.0, 6.0]]), (2, [[1.0, 2.0], [3.0, 4.0]])):
        (tmp_path / f"e_{k}.npy").write_bytes(binary.encode_npy(np.array(m)))
    got = binary.combined(binary.read_npy(spark, str(tmp_path / "e_*.npy"))).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0])]


def test_stores(spark, tmp_path):
    made = []
    build = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert stores.build_or_load(spark, str(tmp_path / "t"), build).count() == 3
    assert len(made) == 1
    for _ in range(2):
        stores.append_log(spark.createDataFrame([("a",)], "value string"), str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 2
    stores.write_cases(spark.createDataFrame([("fail", 1), ("success", 2)], "case string, q int"), str(tmp_path / "cases"))
    assert spark.read.parquet(str(tmp_path / "cases/case=fail")).first()["q"] == 1
    assert stores.split_path("d", "train", 0.02) == "d/train_0.02" and stores.split_path("d", "test", 0.02) == "d/test" and stores.split_path("d", "train", 1) == "d/train"
    assert stores.settings({"a": 1, "b": 2}, {"a": 3, "b": None}) == {"a": 3, "b": 2}
    with pytest.raises(KeyError):
        stores.settings({}, {"z": 1})


def test_resources(tmp_path):
    import gzip
    import zipfile

    (tmp_path / "in/data").mkdir(parents=True)
    with gzip.open(tmp_path / "in/data/a.json.gz", "wt") as f:
        f.write("{}")
    with zipfile.ZipFile(tmp_path / "in/data/b.zip", "w") as z:
        z.writestr("x.txt", "x")
    found = stores.resources(str(tmp_path / "in"), "data", str(tmp_path / "out"))
    assert (tmp_path / "out/data/a.json").read_text() == "{}" and (tmp_path / "out/data/b/x.txt").read_text() == "x" and len(found) == 2
    with pytest.raises(KeyError):
        stores.resources(str(tmp_path / "in"), "other", str(tmp_path / "out"))


def test_hooks_for_hashes_and_locations(spark, tmp_path):
    from pyspark.sql import functions as F

    from cartoquill.functions import bloom
    from cartoquill.sources import tsv

    (tmp_path / "poi.txt").write_text("a b\t1.5\t2.5\nc\t3\t4\n")
    half = lambda x, y: (x / 2, y / 2)
    got = [tuple(r) for r in tsv.read_poi(spark, str(tmp_path / "poi.txt"), address=half).orderBy("poi_id").collect()]
    assert [r[2:] for r in got] == [(0.75, 1.25), (1.5, 2.0)]
    assert tsv.hook("no.such.module:f", half) is half and tsv.hook("math:nothing", half) is half and tsv.hook("math:sqrt", half)(4) == 2
    private = lambda t, slices, bits: F.array(F.length(t) % bits)
    assert spark.range(1).select(bloom.bloom(F.array(F.lit("abc"), F.lit("de")), hasher=private)).first()[0] == [2, 3]
