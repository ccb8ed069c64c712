from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline as p
from cartoquill.llm import shingles

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_sets(texts):
    """Sets of five-word shingles of lower-cased words, all words where there are fewer."""
    split = [(t or "").encode().lower().split() for t in texts]
    return [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in split]


def brute_kept(rows):
    """Ids that are the smallest of their component, by all pairs."""
    sets, parent = brute_sets([t for _, t in rows]), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = len(sets[i]), len(sets[j])
            if 5 * min(a, b) >= 4 * max(a, b):
                c = len(sets[i] & sets[j])
                if 9 * c >= 4 * (a + b):
                    parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted(set(least.values()))


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    return sorted(r["doc_id"] for r in p.near_dedup(spark, docs, "").collect())


def edited(rng, words, n):
    out = list(words)
    for k in rng.choice(len(words), n, replace=False):
        out[k] = f"new{rng.integers(1 << 40)}"
    return " ".join(out)


@pytest.mark.parametrize("tile", [shingles.TILE, 8])
def test_near_dedup_on_edited_texts(spark, monkeypatch, tile):
    monkeypatch.setattr(shingles, "TILE", tile)
    rng = np.random.default_rng(1)
    rows = [(900, None), (901, ""), (902, "one two"), (903, "One  two"), (904, "a b c d e"), (905, "a b c d f"), (906, "x " * 50), (907, "x " * 80)]
    line = " ".join(f"common{k}" for k in range(30))
    for base in range(6):
        words = [f"w{base}x{k}" for k in range(60 + 50 * base)]
        rows += [(100 * base + k, edited(rng, words, n) + " " + line) for k, n in enumerate([0, 0, 1, 1, 2, 2, 3, 4, 5, 7, 9, 12, 20])]
    want = brute_kept(rows)
    assert 10 < len(want) < len(rows) - 10
    assert kept(spark, rows) == want


def test_near_dedup_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert kept(spark, rows) == brute_kept(rows)


def test_similarity_of_exactly_four_fifths():
    a = np.arange(9, dtype=np.uint64)
    links = shingles.Overlaps([a, a[:8], a[:7], a[:4], a[:5]])
    assert links.linked(0, np.array([1, 2])).tolist() == [True, False] and links.linked(3, np.array([4, 0])).tolist() == [True, False]
    none = np.zeros(0, np.uint64)
    assert set(shingles.prefix(a[:5], none, none).tolist()) & set(shingles.prefix(a[1:5], none, none).tolist())


def test_sketches_never_part_similar_sets():
    rng = np.random.default_rng(2)
    for n in (5, 100, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[n // 10 :], rng.integers(0, 1 << 63, n // 20).astype(np.uint64))))
        assert np.bitwise_count(shingles.sketch(a) ^ shingles.sketch(b)).sum() <= len(set(a.tolist()) ^ set(b.tolist()))


def test_buckets_of_prefixes_are_even(spark, monkeypatch):
    """Prefixes hold the smallest hashes, which ranges of hashes would put into a fifth of the buckets."""
    monkeypatch.setattr(shingles.C, "buckets", lambda total: 40)
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(k, " ".join(f"w{x}" for x in rng.integers(1 << 40, size=2000))) for k in range(60)], "doc_id long, text string")
    rows = shingles._described(shingles._rows(docs, "doc_id", "text")).where("kind = 1").select("bucket", "keys").collect()
    held = np.bincount([r["bucket"] for r in rows], [len(shingles.unpack_hashes(r["keys"])) for r in rows], minlength=40)
    assert held.sum() == 60 * (1996 - (4 * 1996 + 4) // 5 + 1) and held.max() < 1.5 * held.mean()


def test_workers_keep_only_the_running_operators_memory(spark):
    """A worker is used again for other stages; the models and words of an operator before went on taking room beside them."""
    from cartoquill.llm import catalogue, tokens, transducer

    transducer.transducer(catalogue._path("piece_bpe_32k.model")).encode("some words")
    shingles.C.only(transducer._made)
    assert transducer._made
    shingles.C.only(tokens._made)
    assert not transducer._made
