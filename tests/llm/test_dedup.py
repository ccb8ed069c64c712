from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
import xxhash

from cartoquill.llm import catalogue, common, simhash, substrings

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, hashes string, component_id string, bucket int"
SPACES = r"[^\x20\x09-\x0D]+"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "h", "c", 1) for i, t in rows], SCHEMA)


def brute_substrings(rows, width=13):
    """rows: (id, text); an id that repeats is one document."""
    first: dict[tuple, int] = {}
    words = [(i, re.findall(SPACES, t or "")) for i, t in rows]
    for i, w in words:
        if i is not None:
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        if i is not None:
            for k in range(len(w) - width + 1):
                if first[tuple(w[k : k + width])] < i:
                    gone.update(range(k, k + width))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substrings_on_odd_rows(spark):
    a = " ".join(f"w{k}" for k in range(30))
    rows = [(5, a), (2, a), (2, a + " tail"), (9, None), (8, ""), (7, "x  \n y"), (None, a), (None, a), (11, "the " * 400), (12, "the " * 40 + "\x00 \x1f ü"), (13, " ".join(f"w{k}" for k in range(5, 18)) + " new " + a[3:]), (14, "w0\x0bw1\x0cw2"), (15, "y" * 300_000 + " " + a)]
    got = substrings.dedup_substrings(frame(spark, rows))
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr) == brute_substrings(rows)
    spans = {r["doc_id"]: [(s["first"], s["end"]) for s in r["removed"]] for r in got.where("doc_id in (5, 12, 13)").collect()}
    assert spans[5] == [(0, 30)] and spans[12] == [(0, 40)] and all(b - a >= 13 for a, b in spans[13])


def thue_morse(n):
    """Two different words of 2**n signs; polynomials modulo a power of two cannot tell them apart."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("bits", [64, 2])
def test_windows_are_judged_by_their_words(spark, bits):
    """With two bits, all windows have hashes that others have too."""
    a, b = thue_morse(10)
    tail = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{a} {tail}"), (2, f"{b} {tail}"), (3, f"{a} {tail}")]
    r = np.random.default_rng(3)
    rows += [(k, " ".join(f"v{x}" for x in r.integers(0, 2, 60))) for k in range(10, 16)] + [(20, rows[0][1] + " x " + tail), (4, "z " * 300)]
    got = substrings.dedup_substrings(frame(spark, rows), bits=bits).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_substrings(rows)


@pytest.mark.parametrize("unit", [60, 500, 8 << 20])
def test_many_units_in_a_task(spark, monkeypatch, unit):
    monkeypatch.setattr(substrings, "UNIT_BYTES", unit)
    r = np.random.default_rng(9)
    lines = [" ".join(f"w{x}" for x in r.integers(0, 50, 15)) for _ in range(20)]
    rows = [(int(r.integers(0, 70)) if k % 9 else None, " ".join(lines[int(x)] for x in r.integers(0, 20, r.integers(0, 5)))) for k in range(80)]
    rows += [rows[3], rows[3], rows[4]]
    docs = frame(spark, rows).coalesce(2)
    assert sorted(map(tuple, substrings.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr) == brute_substrings(rows)


def test_substrings_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, catalogue.op3_substring_dedup(spark, SF).collect()), key=repr) == brute_substrings(rows)


def test_packing():
    h = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (substrings.unpack_hashes(substrings.pack_hashes(h)) == h).all()
    p = np.arange(1000) * 7
    assert (substrings.unpack_places(substrings.pack_places(p)) == p).all()
    a, b = substrings.split_local(substrings.pack_hashes(h) + substrings.pack_places(p))
    assert (a == h).all() and (b == p).all()


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    data = (" ".join(f"word{k % 91}" for k in range(5000)) + " " + "z" * 9000).encode()
    whole, starts = common.word_hashes(data)
    monkeypatch.setattr(common, "_CHUNK", 257)
    again, at = common.word_hashes(data)
    assert (whole == again).all() and (starts == at).all() and len(whole) == 5001
    assert len({common.word_hashes(x)[0][0] for x in (b"a", b"\x00a", b"a\x00", b"aa", b"b")}) == 5


# ---- SimHash


def brute_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(SPACES, t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, most=4):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                parent[find(i)] = find(j)
    low: dict[int, int] = {}
    for k, i in enumerate(ids):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [low.get(find(k)) for k in range(len(ids))]


def check_near(spark, rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], [f"{f:016x}" for f in fps], brute_components([i for i, _ in rows], fps), strict=True), key=repr)
    assert sorted(map(tuple, simhash.near_duplicates(frame(spark, rows)).collect()), key=repr) == want


def test_near_duplicates_on_odd_rows(spark):
    base = [f"w{k}" for k in range(80)]
    rows = [(10, " ".join(base)), (4, " ".join(base).upper()), (6, " ".join([*base[:40], "x", *base[41:]])), (3, " ".join([*base[:20], "y", *base[21:]])), (20, None), (21, ""), (22, " \n "), (23, "one"), (24, "One"), (25, "one two three"), (None, "one two three"), (None, "alone here"), (30, "ü ß É"), (4, "again with the same id"), (40, "the " * 70_000)]
    check_near(spark, rows)


def test_near_duplicates_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_near(spark, rows)


@pytest.mark.parametrize("tile", [simhash.TILE, 16])
def test_links_in_crowded_blocks(spark, monkeypatch, tile):
    """Fingerprints close to a few centres, so that blocks are large, in one tile or many."""
    monkeypatch.setattr(simhash, "TILE", tile)
    r = np.random.default_rng(5)
    centres = [int(x) for x in r.integers(0, 1 << 63, 4)]
    fps = sorted({c ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 7), replace=False)) for c in centres for _ in range(60)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {f: f for f in signed} | {c["child"]: c["root"] for c in simhash.components(simhash.links(rows)).collect()}
    assert got == dict(zip(signed, brute_components(signed, fps), strict=True))


def test_components_of_a_long_path(spark):
    n = 60
    order = np.random.default_rng(2).permutation(n).tolist()
    edges = [(max(a, b), min(a, b)) for a, b in zip(order, order[1:], strict=False)]
    got = simhash.components(spark.createDataFrame(edges, "child long, root long")).collect()
    assert {r["child"]: r["root"] for r in got} == {k: 0 for k in range(1, n)}


def test_masks_cover_every_pair_within_the_distance():
    r = np.random.default_rng(3)
    masks = simhash.masks(4)
    assert len(masks) == 15
    for _ in range(300):
        x = sum(1 << int(b) for b in r.choice(64, 4, replace=False))
        assert any(x & m == 0 for m in masks)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert substrings.dedup_substrings(none).count() == 0 and simhash.near_duplicates(none).count() == 0
