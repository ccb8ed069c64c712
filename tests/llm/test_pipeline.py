from __future__ import annotations

import hashlib
import re

import corpus_pipeline as p

SF = "/root/testdata/sf0.001"


def shared(item: str, text: str) -> float:
    """The share of an item's words that lie in runs of four words which the text has too."""
    a, b = (re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t)) for t in (item, text))
    runs, covered = {tuple(b[k : k + 4]) for k in range(len(b) - 3)}, set()
    for k in range(len(a) - 3):
        if tuple(a[k : k + 4]) in runs:
            covered.update(range(k, k + 4))
    return len(covered) / len(a)


def test_stages_follow_each_other(spark, tmp_path):
    import __spark_entry__ as e
    from test_dedup import brute_substrings
    from test_shingles import brute_kept

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()} if k < len(p.STAGES) - 1 else [tuple(r) for r in docs.collect()]
        assert k == len(p.STAGES) - 1 or docs.columns == columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(i in kept["quality"] for i, q in labels.items() if q == 1)
    assert sorted(kept["near_dedup"]) == brute_kept(sorted(kept["quality"].items()))
    b = kept["near_dedup"]
    removed = {r[0]: r for r in brute_substrings(list(b.items()))}
    c = kept["substring_dedup"]
    for i, text in b.items():
        _, n, gone, sha = removed[i]
        if gone == 0:
            assert c[i] == text
        elif gone == n:
            assert i not in c
        else:
            assert hashlib.sha256(c[i].encode()).hexdigest() == sha
    d = kept["decontamination"]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(d) <= set(c) and not any(t in x for x in d.values() for t in items)
    assert all(max(shared(t, c[i]) for t in items) >= 0.5 for i in set(c) - set(d))
    import public_tokenizers
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r[0]: r[1] for r in kept["piece_ids"]} == {i: m.encode(x) for i, x in d.items()}
    assert sorted(map(tuple, e.queries()["pipeline"](spark, SF).collect())) == sorted(kept["piece_ids"])


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    long = " ".join(f"w{k * 7919 % 5003}" for k in range(60_000))
    odd = spark.createDataFrame([(None, "a text of its own that no other row of the table has", None, None, None), (None, None, "en", "s", 0), (7, "", "en", "s", 0), (7, "", "en", "s", 0), (8, "one", "en", "s", 3), (8, "two", "en", "s", 3), (9, long, "en", "s", len(long)), (10, long, "en", "s", len(long))], docs.schema)
    names = ["rejected", "kept", "leak", "doc_key", "at", "row", "text_", "fp", "hashes", "item_id", "carried_0", "n"]
    rows = docs.unionByName(odd).selectExpr("*", *[f"doc_id AS {n}" for n in names])
    for name, stage in p.STAGES:
        out = stage(spark, rows, SF)
        got = out.collect()
        if name != "piece_ids":
            assert out.columns == docs.columns and len(got) > 20
        if name == "near_dedup":
            own = [(r["doc_id"], r["text"]) for r in got]
            assert len(set(own)) == len(own) and (None, odd.first()["text"]) in own
            assert (8, "one") in own and (8, "two") in own and (9, long) in own and (10, long) not in own
            assert len([t for _, t in own if not t]) == 1 and (7, "") in own
        if name == "decontamination":
            assert len([r for r in got if r["doc_id"] is None]) == 2
        assert stage(spark, rows.where("false"), SF).count() == 0


def test_names():
    assert [n for n, _ in p.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontamination", "piece_ids"]
