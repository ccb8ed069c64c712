from __future__ import annotations

import base64
import hashlib

import numpy as np
import pytest

from cartoquill.llm import catalogue, neighbours, warc

SF = "/root/testdata/sf0.001"


def brute_nearest(rows, k, every):
    """Each row is a query of its own and a candidate for all others, whatever ids they share."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    out = []
    for n, (q, a) in enumerate(good):
        if q % every == 0:
            scored = [(-sum(x * y for x, y in zip(a.tolist(), b.tolist(), strict=True)), i) for m, (i, b) in enumerate(good) if m != n and len(a) == len(b)]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_nearest_on_odd_rows(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in r.normal(0, 1, 8)]) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(30)] + [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [float("inf")] + [1.0] * 7), (204, [None] + [1.0] * 7), (None, [1.0] * 8), (20, [0.5] * 8), (40, rows[40][1]), (205, [1.0, 2.0]), (220, [1.0, 1.0]), (206, []), (230, [1e6] * 8), (240, [1e-6] * 8)]
    df = spark.createDataFrame([(i, v, 0.5) for i, v in rows], "vec_id long, embedding array<float>, score double")
    rows = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for k, every in ((5, 20), (200, 50)):
        got = sorted(map(tuple, neighbours.nearest(df, k, every).collect()))
        want = brute_nearest(rows, k, every)
        assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-12)
    twins = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [1.0, 0.0]), (7, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, neighbours.nearest(twins, 2).collect()))
    assert got == [(20, 1, 7, 0.5), (20, 1, 20, 1.0), (20, 1, 20, 1.0), (20, 2, 7, 0.5), (20, 2, 7, 0.5), (20, 2, 20, 0.0)]
    assert neighbours.nearest(df.where("false")).count() == 0 and neighbours.nearest(df.where("vec_id = 0")).count() == 0 and neighbours.nearest(df.where("vec_id = 20")).count() == 2


def test_nearest_query_in_many_blocks(spark, same, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    monkeypatch.setattr(neighbours, "ROW_BLOCK", 90)
    same(catalogue.op4_nearest_neighbours(spark, SF), catalogue.ORACLE_SQL["op4_nearest_neighbours"], SF)


def test_bounds_hold():
    r = np.random.default_rng(1)
    q, x = r.normal(0, 3, (40, 16)), r.normal(0, 0.01, (200, 16))
    for i, ids, score in neighbours.tile(q, x, np.arange(200), np.full(40, -1), 3):
        assert ids.tolist() == np.argsort(-(x @ q[i]), kind="stable")[:3].tolist() and np.allclose(score, np.sort(x @ q[i])[::-1][:3])


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_warc_on_odd_rows(spark, tmp_path):
    pages = [(1, "http://a/?q=ü x\r\nInjected: 1", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "unique\r\n\r\nWARC/1.1\r\n"), (None, "u", "<p>é</p>"), (2, "u", "<p>é</p>"), (6, "u", "x" * 700_000), (7, "", "x" * 700_000), (8, "u", "y" * 300_000)]
    df = spark.createDataFrame([(*p, "d") for p in pages], "page_id long, url string, html string, digest string")
    got = sorted(map(tuple, warc.warc_archive(df, folder=str(tmp_path / "w")).collect()), key=repr)
    top = {}
    for i, _, h in pages:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    want = [(i, len((h or "").encode()), digest((h or "").encode()), "response" if i == top[h or ""] else "revisit", None if i == top[h or ""] else top[h or ""]) for i, _, h in pages]
    assert got == sorted(want, key=repr)
    large = warc.warc_archive(df, min_bytes=100).where("payload_bytes < 100")
    assert {r["record_type"] for r in large.collect()} == {"response"}
    assert warc.warc_archive(df.where("false")).count() == 0


def test_bundle_is_seekable(spark, tmp_path):
    import zstandard

    pages = spark.createDataFrame([(i, "u", f"page {i} " * 20_000) for i in range(12)], "page_id long, url string, html string").coalesce(1)
    written = warc.write_warc(pages, str(tmp_path))
    one = next(tmp_path.glob("*.warc.zst"))
    lost = tmp_path / one.name.replace(one.name.split("-")[2], "999999")
    lost.write_bytes(one.read_bytes())  # left by an attempt that was lost
    assert warc.read_warc(spark, str(tmp_path), written).count() == 12
    for p in tmp_path.glob("*.warc.zst"):
        content = p.read_bytes()
        r = warc.Reader(content)
        assert len(r.sizes) > 1
        stream = b"".join(r.frame(k) for k in range(len(r.sizes)))
        for name, k, at, size in r.index():
            headers, block = warc.parse(r.frame(k)[at : at + size])
            assert headers["WARC-Record-ID"] == name and block.endswith(f"page {name[10:-1]} ".encode())
        with zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True) as f:  # any reader skips what is not a frame of records
            assert f.read() == stream
        with pytest.raises(ValueError):
            warc.Reader(content[:-3] + b"abc")


def test_warc_query(spark, same):
    same(catalogue.op8_warc(spark, SF), catalogue.ORACLE_SQL["op8_warc"], SF)
