from __future__ import annotations

import re
import zlib

import numpy as np
import pytest

from cartoquill.llm import catalogue, licenses, quality, tiling

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    rows = catalogue.op6_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    found = rows.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r["held_out"]]
    assert len(held) > 50 and np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, "fine words here", 0), (1, "fine words here", 0), (2, None, 1), (3, "", 1), (None, "x", 0), (4, "!!! ### " * 50_000, 1)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(1, 1, 5), (4, 0, 5), (2, None, 5), (3, 7, 5), (None, 1, 5)], "doc_id long, quality int, text int")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
    none = labels.where("false")
    assert {r["score"] for r in quality.quality_scores(docs, none).collect()} == {0.5}
    one = quality.quality_scores(docs, labels.where("quality = 1")).collect()
    assert all(r["score"] >= 0.5 for r in one)
    assert quality.quality_scores(docs.where("false"), labels).count() == 0


def test_scores_are_the_discriminants(spark):
    """The query against densities with inverted covariances, from the features of training rows."""
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    y = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    x = {i: np.array(quality.statistics(t)) for i, t in texts.items()}
    train = [i for i in y if i in x and zlib.crc32(str(i).encode()) % 3 != 1]
    both = np.array([x[i] for i in train])
    mean, std = both.mean(axis=0), both.std(axis=0)
    std = np.where(std < 1e-5, 1, std)
    z = {c: (np.array([x[i] for i in train if y[i] == c]) - mean) / std for c in (0, 1)}
    cov = {c: np.cov(z[c].T, bias=True) for c in z}
    share = {c: len(z[c]) / len(train) for c in z}
    pooled = np.diag(sum(share[c] * np.diag(cov[c]) for c in z))
    s = {c: (1 - quality.SHRINK) * cov[c] + quality.SHRINK * pooled + quality.RIDGE * np.eye(len(mean)) for c in z}

    def density(c, v):
        d = (v - mean) / std - z[c].mean(axis=0)
        return np.log((len(z[c]) + 1) / (len(train) + 2)) - 0.5 * np.linalg.slogdet(s[c])[1] - 0.5 * d @ np.linalg.inv(s[c]) @ d

    for r in catalogue.op6_quality(spark, SF).collect():
        gap = density(1, x[r["doc_id"]]) - density(0, x[r["doc_id"]])
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(gap, -700, 700))), abs=1e-6)


def test_quality_uses_only_training_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end as quality")
    a, b = ({r["doc_id"]: r["score"] for r in quality.quality_scores(docs, x).collect()} for x in (labels, flipped))
    assert a == pytest.approx(b, abs=1e-9)


# ---- licenses


def brute_scan(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    found, base = [], set()
    for p, label in licenses.PHRASES:
        p = p.split()
        at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
        found += at
        if at:
            base.add(label)
    return len(w), len(found), min(found, default=None), max(found, default=None), ",".join(sorted(base))


def test_license_odd_rows(spark):
    texts = [None, "", "MIT License", "mit-license MIT LICENSE mit license", "the MIT\x00License!", "limit license", "mit license2", "apache license mit license general public license", "Éapache license", "gnu GENERAL public\nlicense " * 3000, "İ mit license", "Released under the MIT License."]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)] + [(None, "mit license", "x"), (2, "MIT License", "x")], "doc_id long, text string, labels string")
    rows = licenses.license_scan(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r["doc_id"] is not None:
            assert tuple(r)[1:6] == brute_scan(texts[r["doc_id"]])
            assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert licenses.license_scan(docs.where("false")).count() == 0


def test_license_query(spark, same):
    same(catalogue.op9_licenses(spark, "/root/testdata/sf0.001"), catalogue.ORACLE_SQL["op9_licenses"], "/root/testdata/sf0.001")


MIT = """MIT License  Copyright (c) 2020 Jane Doe and others
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_whole_licenses_with_their_optional_and_replaceable_wording(spark, same, tmp_path):
    changed = [MIT, MIT.replace("ANY CLAIM", "SOME CLAIM"), MIT.replace("the Software", "the Work of Art"), MIT.replace("this permission notice shall", "this permission notice (including the next paragraph) shall"), "noise " * 30_000 + MIT + " more", "This work is licensed under the GNU General Public License version 3 or later.", "licensed under the general public license"]
    docs = spark.createDataFrame(list(enumerate(changed)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}
    assert [("mit" in got[i]["labels"].split(",")) for i in range(5)] == [True, False, True, True, True]
    n = len(licenses.words_of(MIT.encode()))
    assert got[0]["spans"].startswith(f"mit:0-{n},") and got[4]["spans"].startswith(f"mit:30000-{30_000 + n},")
    assert got[5]["spans"] == "gpl-notice:0-13" and got[6]["spans"] == "gpl-notice:0-6"
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = c.sql(catalogue.ORACLE_SQL["op9_licenses"])
    assert {r[0]: dict(zip(found.columns, r, strict=True)) for r in found.fetchall()} == {i: r.asDict() for i, r in got.items()}


def test_templates():
    a = licenses.compile_template("t", "[[this work is]] licensed under <<2>> license [[version <<1>> [[or later]]]]")
    w = lambda s: s.split()

    def words(s):
        return [x.encode() for x in w(s)]

    accept = lambda s: [a.accepts(words(s), k) for k in range(len(w(s)) - a.size + 1) if words(s)[k : k + a.size] == a.key.split()]
    assert a.key == b"licensed under"
    assert accept("x this work is licensed under the new license version 3 or later y") == [(1, 13)]
    assert accept("licensed under license") == [(0, 3)]
    assert accept("licensed under a b c license") == [None]
    assert accept("licensed under the mit licence") == [None]
    assert accept("a licensed under the license version") == [(1, 6)]
    for bad in ("[[ only ]] <<3>>", "[[ open", "shut ]]"):
        with pytest.raises(ValueError):
            licenses.compile_template("t", bad)


# ---- tiling


def brute_tiles(item, doc, shortest):
    """Greedy string tiling by the book: the longest unmarked match, ties to the first places, is marked, again and again."""
    in_item, in_doc, out = [False] * len(item), [False] * len(doc), []
    while True:
        best = (0,)
        for a in range(len(item)):
            for b in range(len(doc)):
                n = 0
                while a + n < len(item) and b + n < len(doc) and not in_item[a + n] and not in_doc[b + n] and item[a + n] == doc[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        if best[0] < shortest:
            return out
        n, a, b = best
        in_item[a : a + n] = in_doc[b : b + n] = [True] * n
        out.append((a, b, n))


def test_tiles_against_brute_force():
    import random

    r = random.Random(1)
    for _ in range(400):
        v = r.choice([1, 2, 3, 6])
        item = [b"w%d" % r.randrange(v) for _ in range(r.randrange(1, 25))]
        doc = [b"w%d" % r.randrange(v + 1) for _ in range(r.randrange(0, 40))]
        s = min(r.choice([1, 2, 3, 4]), len(item))
        want = brute_tiles(item, doc, s)
        assert tiling.tiles(item, doc, s) == want
        share, covered = r.choice([0.2, 0.5, 0.9]), sum(x[2] for x in want)
        got = list(tiling.match([b" ".join(doc)], tiling.Items([(7, b" ".join(item))], s), share))
        assert got == ([(0, 0, len(want), covered, covered / len(item))] if covered >= share * len(item) else [])


def test_tiles_when_hashes_collide(monkeypatch):
    first = tiling.Rolling.windows
    monkeypatch.setattr(tiling.Rolling, "windows", lambda self, starts, n: first(self, starts, n) % 3 if self.fields[0][0][1] == seed_0 else first(self, starts, n))
    seed_0 = tiling.Rolling(np.zeros(1, np.int64), 0, 4).fields[0][0][1]
    item, doc = [b"a", b"b", b"c", b"d", b"e", b"f"], [b"x", b"e", b"f", b"a", b"b", b"c", b"y"]
    assert tiling.tiles(item, doc, 2) == brute_tiles(item, doc, 2)


def test_a_repetitive_item_and_a_long_repetitive_text():
    import resource

    items = tiling.Items([(1, b"a " * 100), (2, b"b b")], 4)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert sorted(tiling.match([b"a " * 2_500_000, b"c " * 10 + b"b b"], items, 0.5)) == [(0, 0, 1, 100, 1.0), (1, 1, 1, 2, 1.0)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20


def test_contaminated(spark):
    passage = "The quick, brown fox; jumps over the lazy dog while twelve small cats watch from a warm red wall"
    w = passage.split()
    turned = " ".join([*w[10:], "and then", *w[:10]])
    texts = [passage, f"before {passage.upper()} after", turned, " ".join(w[:6]) + " other words follow here", None, "", "red wall", "x " * 20_000 + turned, " ".join(reversed(w))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, passage, 2), (0, passage, 3)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, passage, 0), (2, "unrelated words that nothing holds at all", 0), (3, None, 0), (4, "too short", 0), (None, passage, 0)], "item_id long, text string, doc_id int")
    rows = tiling.contaminated(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(d, i) for d in (0, 1, 2, 7, None) for i in (1, None)}
    assert len(rows) == 12 and all(r["coverage"] == 1.0 for r in rows)
    assert tiling.contaminated(docs, items.where("false")).count() == 0 and tiling.contaminated(docs.where("false"), items).count() == 0


def test_items_joined_by_their_seeds(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "ein"), (901, ""), (902, "of the")], "item_id long, text string"))
    whole = sorted(map(tuple, tiling.contaminated(docs, items).collect()))
    monkeypatch.setattr(tiling, "SENT_BYTES", 0)
    assert sorted(map(tuple, tiling.contaminated(docs, items).collect())) == whole
    held = {(r["doc_id"], i["item_id"]) for r in docs.collect() for i in items.collect() if i["text"] and f" {i['text']} " in f" {r['text']} "}
    assert held <= {x[:2] for x in whole}


def test_the_query_against_brute_force(spark):
    split = lambda t: [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))]
    docs = [(r["doc_id"], split(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], split(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = set()
    for i, item in items:
        seeds = {tuple(item[k : k + 4]) for k in range(len(item) - 3)}
        for d, doc in docs:
            runs = {k + x for k in range(len(doc) - 3) if tuple(doc[k : k + 4]) in seeds for x in range(4)}
            if len(runs) >= 4:  # words outside of shared runs can't be in a tile
                found = brute_tiles(item, [w if k in runs else b"" for k, w in enumerate(doc) if k in runs or k - 1 in runs], 4)
                if (n := sum(x[2] for x in found)) >= 0.5 * len(item):
                    want.add((d, i, len(found), n))
    assert want and {tuple(r)[:4] for r in catalogue.op10_decontamination(spark, SF).collect()} == want
