from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartoquill.functions import bloom, text
from cartoquill.operators import datasets, dense, lexical, metrics, network, ranker, report, scan, search, training, tree
from cartoquill.sources import binary
from cartoquill.streaming import search as streaming


def ranked(spark, lists, truths):
    r = spark.createDataFrame([(q, k + 1, p) for q, l in lists.items() for k, p in enumerate(l)], "query_id long, rank int, poi_id long")
    t = spark.createDataFrame([(q, p) for q, l in truths.items() for p in l], "query_id long, poi_id long")
    return r, t


def test_metrics_golden(spark):
    r, t = ranked(spark, {0: [5, 3, 9], 1: [1]}, {0: [3, 9]})
    q = spark.createDataFrame([(0,), (1,), (2,)], "query_id long")
    names = {"ndcg_5": ("ndcg", 5), "r1": ("recall", 1), "r2": ("recall", 2), "r3": ("recall", 3), "mrr": ("mrr", 5)}
    rows = {x["query_id"]: x for x in metrics.per_query(q, r, t, names).collect()}
    assert round(rows[0]["ndcg_5"], 7) == 0.6934264
    assert [rows[0][n] for n in ("r1", "r2", "r3", "mrr")] == [0, 0.5, 1, 0.5]
    assert all(rows[k][n] == 0 for k in (1, 2) for n in names)
    assert metrics.mean(metrics.per_query(q, r, t, names), list(names)).first()["n_queries"] == 3


def test_lambda_loss_golden(spark):
    s = spark.createDataFrame([(0, 1, 2.0, 0), (0, 2, 1.0, 1), (0, 3, 0.5, 0)], "query_id long, item long, score double, label int")
    assert round(metrics.reduced(metrics.lambda_loss(s)).first()["loss"], 4) == 2.5786
    for name in metrics.SCHEMES:
        assert metrics.reduced(metrics.lambda_loss(s, scheme=name), "mean").first()["pairs"] == (9 if name == "ndcgLoss1" else 2)


@pytest.fixture(scope="module")
def world(spark):
    words = ["cafe", "park", "inn", "north", "south", "old", "new", "river"]
    poi = spark.range(120).select(F.col("id").alias("poi_id"), F.concat_ws(" ", *[F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(8)) + 1).cast("int")) for k in range(3)]).alias("text"), (F.pmod(F.xxhash64("id", F.lit(8)), F.lit(100))).cast("double").alias("x"), (F.pmod(F.xxhash64("id", F.lit(9)), F.lit(100))).cast("double").alias("y"))
    q = spark.createDataFrame([(0, "cafe north", 10.0, 10.0), (1, "old inn river", 50.0, 90.0), (2, "nothing known", 5.0, 5.0)], "query_id long, text string, x double, y double")
    bits = lambda r, k: bloom.exploded(r, k, "text", text.words)
    return poi.cache(), q, bits(poi, "poi_id").cache(), bits(q, "query_id").cache()


def brute(world, k):
    poi, q, pb, qb = world
    bits = {}
    for r in pb.collect():
        bits.setdefault(r["poi_id"], set()).add(r["bit"])
    asked = {}
    for r in qb.collect():
        asked.setdefault(r["query_id"], set()).add(r["bit"])
    out = []
    for a in q.collect():
        o = {p["poi_id"]: len(bits[p["poi_id"]] & asked[a["query_id"]]) for p in poi.collect()}
        mean, dev = np.mean(list(o.values())), np.std(list(o.values()), ddof=1) or 1.0
        score = {p["poi_id"]: (1 - 1 / (1 + math.exp(-(o[p["poi_id"]] - mean) / dev))) * (-math.log(1 + math.hypot(p["x"] - a["x"], p["y"] - a["y"])) - 1) for p in poi.collect()}
        out += [(a["query_id"], r + 1, i) for r, i in enumerate(sorted(score, key=lambda i: (-round(score[i], 9), i))[:k])]
    return out


def test_exhaustive_against_brute_force(spark, world):
    got = search.exhaustive(*world, k=10)
    assert sorted((r["query_id"], r["rank"], r["poi_id"]) for r in got.collect()) == brute(world, 10)
    blocks = [b for b in search.in_blocks(world[1], 2) if not b.isEmpty()]
    parts = [r for b in blocks for r in search.exhaustive(world[0], b, world[2], world[3].join(b.select("query_id"), "query_id", "left_semi"), 10).collect()]
    assert sorted((r["query_id"], r["rank"], r["poi_id"]) for r in parts) == brute(world, 10)


def test_tree_and_beam(spark, world):
    poi, q, pb, qb = world
    node, edges, bits = tree.build(poi, pb, width=4)
    depths = node.agg(F.max("depth")).first()[0] + 1
    top = node.where("depth = 0").count()
    assert top <= 16 and node.where(F.col("depth") == depths - 1).count() == 120
    # Union filters hold all bits below them, so overlap never grows downwards.
    for d in range(depths - 1):
        e = edges.where(F.col("depth") == d).select(F.col("child_id").alias("node_id"), "parent_id")
        below = bits.where(F.col("depth") == d + 1).join(e, "node_id").select(F.col("parent_id").alias("node_id"), "bit")
        assert below.join(bits.where(F.col("depth") == d), ["node_id", "bit"], "left_anti").isEmpty()
    # A beam as wide as every level scores all places; its last depth is the exhaustive result.
    wide = search.beam_search(node, edges, bits, q, qb, depths, 120)
    last = wide.where((F.col("depth") == depths - 1) & (F.col("rank") <= 10))
    assert sorted((r["query_id"], r["rank"], r["node_id"]) for r in last.collect()) == brute(world, 10)
    narrow = search.beam_search(node, edges, bits, q, qb, depths, 3)
    assert narrow.groupBy("query_id", "depth").count().agg(F.max("count")).first()[0] <= 3
    weights = [network.Weights.untrained(bloom.SLICES * bloom.BITS)] * depths
    scored = search.beam_search(node, edges, bits, q, qb, depths, 3, text_score=network.scorer(network.node_index(node, bits, weights), bits, qb, network.Model.of(weights)))
    assert scored.exceptAll(narrow).isEmpty()
    merged, _, _ = tree.build(poi, pb, width=4, levels=1, merge_small=True)
    assert merged.where("depth = 0").count() <= tree.build(poi, pb, width=4, levels=1)[0].where("depth = 0").count()


def test_filters_held_as_arrays(spark, world):
    """A row for each filter gives the rows that a row for each bit gives, and no step makes a row for each bit."""
    poi, q, pb, qb = world
    held = bloom.filters(poi, "text").where("size(bits) > 0")
    assert {(r["poi_id"], b) for r in held.collect() for b in r["bits"]} == {tuple(r) for r in pb.select("poi_id", "bit").collect()}
    node, edges, bits = tree.build(held, held, width=4)
    plain, plain_edges, exploded = tree.build(poi, pb, width=4)
    assert edges.exceptAll(plain_edges).isEmpty() and exploded.exceptAll(bits.select("depth", "node_id", F.explode("bits").alias("bit"))).isEmpty()
    assert tree.density(bits, 100).exceptAll(tree.density(exploded, 100)).isEmpty() and report.sizes(bits).exceptAll(report.sizes(exploded)).isEmpty()
    depths = node.agg(F.max("depth")).first()[0] + 1
    beam = search.beam_search(node, edges, bits, q, qb, depths, 3)
    assert beam.exceptAll(search.beam_search(plain, plain_edges, exploded, q, qb, depths, 3)).isEmpty()
    weights = [network.Weights.random(bloom.SLICES * bloom.BITS, d) for d in range(depths)]
    scored = [search.beam_search(node, edges, b, q, qb, depths, 3, text_score=network.scorer(network.node_index(node, b, weights), b, qb, network.Model.of(weights))) for b in (bits, exploded)]
    assert scored[0].count() and scored[0].exceptAll(scored[1]).isEmpty()
    asked, make = [], network.needed(node, bits, weights)
    lazy = lambda ids, depth: (asked.append((depth, ids.select("node_id").distinct().count())), make(ids, depth))[1]
    assert scored[0].exceptAll(search.beam_search(node, edges, bits, q, qb, depths, 3, text_score=network.scorer(lazy, bits, qb, network.Model.of(weights)))).isEmpty()
    assert all(n <= 9 for d, n in asked if d) and len(asked) == depths  # only the candidates' nodes are embedded
    found = search.overlap(held, qb)
    assert found.exceptAll(pb.join(qb, "bit").groupBy("query_id", "poi_id").agg(F.count("*").alias("overlap"))).isEmpty() and found.count()
    for made in (beam, found, search.exhaustive(held, q, held, qb)):
        assert "Generate" not in made._jdf.queryExecution().toString()


def test_best_of_batches():
    r = np.random.default_rng(1)
    score, ids = r.integers(0, 9, (3, 500)) / 8, r.permutation(500)
    score[1, ::7] = np.nan
    best = scan.Best(3, 20)
    for a in range(0, 500, 37):
        best.add(score[:, a : a + 37], ids[a : a + 37], np.broadcast_to(ids[a : a + 37] * 2, (3, len(ids[a : a + 37]))))
    (batch,) = best.rows([5, 6, 7], "qisx")
    got = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
    want = [(q + 5, int(ids[i]), score[q, i], int(ids[i]) * 2) for q in range(3) for i in sorted((i for i in range(500) if score[q, i] == score[q, i]), key=lambda i: (-score[q, i], ids[i]))[:20]]
    assert got == want


def test_network_scores_in_steps(monkeypatch):
    """So few numbers at a time that each node is a step of its own."""
    m, r = network.Model.of([network.Weights.random(64, 3)]), np.random.default_rng(5)
    args = np.sort(r.choice(64, 9, replace=False)), r.integers(-9000, 9000, (40, 32)), r.random((40, 9)) < 0.5, r.uniform(0, 3000, (40, 2))
    whole = m.scores(0, *args).tolist()
    monkeypatch.setattr(network.Model, "CELLS", 1)
    assert m.scores(0, *args).tolist() == whole


def test_dense_searches_hold_little_at_once(spark, monkeypatch):
    """With steps of 7 rows and queries as with one step; truths are counted by label, no pair of vectors of a label is a row."""
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in r.normal(0, 1, 4)], int(r.integers(0, 5)) if i else 9, float(r.uniform(0, 9)), float(r.uniform(0, 9))) for i in range(150)]
    corpus = spark.createDataFrame(rows, "vec_id long, v array<double>, label int, x double, y double").cache()
    queries, norm = corpus.where("vec_id % 5 = 0"), spark.createDataFrame([(10.0,)], "d_norm double")
    searches = [lambda: dense.cosine_topk(corpus, queries, 8), *[lambda how=how: dense.cosine_distance_topk(corpus, queries, norm, 8, 0.4, how) for how in ("max", "min_max")], lambda: dense.positive_ranks(corpus, queries, dense.first_of_label(corpus, queries))]
    assert sum(s().count() for s in searches) == 30 * 24 + 29
    largest = []
    add = scan.Best.add
    monkeypatch.setattr(scan.Best, "add", lambda self, score, *more: (largest.append(score.shape), add(self, score, *more))[1])
    monkeypatch.setattr(dense, "STEP", 7)
    state, unit = dense.Bests(np.arange(20), 3), r.normal(0, 1, (20, 4))
    state.add(lambda at: unit[at] @ unit.T, np.arange(20))
    assert max(s[0] for s in largest) == 7 and sum(b.num_rows for b in state.rows()) == 60
    label = {x[0]: x[2] for x in rows}
    first = {x["query_id"]: x["vec_id"] for x in dense.first_of_label(corpus, queries).collect()}
    assert first == {q: min(i for i in label if i != q and label[i] == label[q]) for q in label if q % 5 == 0 and q}
    found, n = dense.labelled(dense.cosine_topk(corpus, queries, 8), corpus, queries)
    assert {x["query_id"]: x["n_truth"] for x in n.collect()} == {q: sum(label[i] == label[q] for i in label) - 1 for q in label if q % 5 == 0 and q}
    assert all(x["hit"] == (label[x["vec_id"]] == label[x["query_id"]]) for x in found.collect())
    brute = {x[0]: np.array(x[1]) / np.linalg.norm(x[1]) for x in rows}
    top = {(x["query_id"], x["rank"]): x["vec_id"] for x in found.collect()}
    assert all([top[q, k + 1] for k in range(8)] == sorted((i for i in brute if i != q), key=lambda i: (-round(float(brute[q] @ brute[i]), 9), i))[:8] for q in range(0, 150, 5))


def slow_scores(m, depth, bits, nodes, has, xy):
    """The network's text scores, one number after the other."""
    clip = lambda x, most=127: max(0, min(most, x))
    n = max(1, len(bits))
    x = [clip(sum(int(m.encoder[b][j]) for b in bits) + int(m.encoder_bias[j]), 127 * n) for j in range(256)]
    query = [int(sum(int(w) * v for w, v in zip(row, x, strict=True)) / n) for row in m.bottleneck[depth]]
    layer = lambda part, h: [clip(sum(int(w) * v for w, v in zip(row, h, strict=True)) + int(b) >> 6) for row, b in zip(part[0], part[1], strict=True)]

    def chunks(part, h, b):
        return [sum(h[4 * c + k] * int(part[2][b][4 * c + k]) for k in range(4)) for c in range(8)]

    def leaky(lists):
        return sum(sum(max(x, 0) for x in lane) + (sum(min(x, 0) for x in lane) >> 4) for lane in zip(*lists, strict=True)) if lists else 0

    hidden = [[clip(q + int(v) >> 6) for q, v in zip(query, node, strict=True)] for node in nodes]
    select, total = [], []
    for h, own in zip(hidden, has, strict=True):
        shared = [b for b, o in zip(bits, own, strict=True) if o]
        select.append(8128 * len(shared) + sum(max(x, 0) for b in shared for x in chunks(m.heads["context_select"][depth], layer(m.heads["context_select"][depth], h), b)))
        rank = layer(m.heads["rank"][depth], h)
        rest = layer(m.residual[depth], h)
        total.append(8128 * len(shared) + leaky([chunks(m.heads["rank"][depth], rank, b) for b in shared]) + 16 * sum(a * int(w) for a, w in zip(rest, m.residual[depth][2], strict=True)))
    for i, h in enumerate(hidden):
        if all(has[i]):
            continue
        for j in sorted(range(len(nodes)), key=lambda j: -select[j])[:30]:
            if j != i and sum((a - b) ** 2 for a, b in zip(xy[i], xy[j], strict=True)) <= 1e6:
                c = layer(m.heads["context_rank"][depth], h)
                total[i] += leaky([chunks(m.heads["context_rank"][depth], c, b) for k, b in enumerate(bits) if not has[i][k] and has[j][k]])
                break
    return total


def test_network_scores_against_brute_force():
    first = network.Weights.random(64, 3)
    m = network.Model.of([first, network.Weights.random(64, 4, first.encoder)])
    r = np.random.default_rng(5)
    changed = 0
    for depth in (0, 1, 1):
        bits = np.sort(r.choice(64, 9, replace=False))
        nodes, has, xy = r.integers(-9000, 9000, (40, 32)), r.random((40, 9)) < 0.5, r.uniform(0, 3000, (40, 2))
        has[0] = True
        got = m.scores(depth, bits, nodes, has, xy).tolist()
        assert got == slow_scores(m, depth, bits.tolist(), nodes.tolist(), has.tolist(), xy.tolist())
        changed += sum(a != b for a, b in zip(got, m.scores(depth, bits, nodes, has, xy + np.arange(40)[:, None] * 9e9).tolist(), strict=True))
    assert changed > 20  # contexts count


def test_network_files(spark, tmp_path):
    w = [network.Weights.random(64, d) for d in range(3)]
    m = network.Model.of(w, [(1.5, 0.25, 1.0, 0.5)] * 3)
    binary.write_model(m.to_bytes(), str(tmp_path / "model.bin"))
    back = network.Model.from_bytes(binary.read_model(spark, str(tmp_path / "model.bin")), 64)
    assert back.to_bytes() == m.to_bytes() and back.fusion.tolist() == m.fusion.tolist()
    r = np.random.default_rng(1)
    args = np.array([3, 5, 9]), r.integers(-9000, 9000, (6, 32)), r.random((6, 3)) < 0.5, r.uniform(0, 900, (6, 2))
    assert all((m.scores(d, *args) == back.scores(d, *args)).all() for d in range(3))
    for bad in (m.to_bytes()[:-1], m.to_bytes() + b"x"):
        with pytest.raises(ValueError):
            network.Model.from_bytes(bad, 64)
    assert np.abs(network.clipped(w[0]).bottleneck).max() <= 127 / 64
    bits = spark.createDataFrame([(0, 1, 2), (0, 1, 3), (1, 4, 2), (1, 0, 7)], "depth int, node_id long, bit int")
    e = network.node_embeddings(bits, w)
    binary.write_nodes(e, str(tmp_path / "node.bin"))
    want = {(r["depth"], r["node_id"]): list(r["embedding"]) for r in e.collect()}
    got = {(r["depth"], r["number"]): list(r["embedding"]) for r in binary.read_nodes(spark, str(tmp_path / "node.bin"), [1, 2]).collect()}
    assert got == {(0, 0): want[0, 1], (1, 0): want[1, 0], (1, 1): want[1, 4]}
    with pytest.raises(Exception, match="bytes for"):
        binary.read_nodes(spark, str(tmp_path / "node.bin"), [1, 3]).collect()


@pytest.mark.parametrize("ordered", [False, True])
def test_ranker_against_brute_force(spark, ordered):
    r, m = np.random.default_rng(3), ranker.Ranker.random(64, 6, 5, seed=2, ordered=ordered)
    m.bits -= 0.4  # some text scores are below 0
    texts = [[[int(b) for b in r.choice(64, 2, replace=False)] for _ in range(r.integers(0, 5))] for _ in range(60)]
    xy = r.uniform(0, 100, (60, 2)).round(2).tolist()
    sets = [sorted({b for w in t for b in w}) for t in texts]
    poi = spark.createDataFrame([(i, *xy[i]) for i in range(50)], "poi_id long, x double, y double")
    q = spark.createDataFrame([(i, *xy[i]) for i in range(50, 60)], "query_id long, x double, y double")
    bits = lambda ids, key: spark.createDataFrame([(i, b) for i in ids for b in sets[i]], f"{key} long, bit int")
    lists = lambda ids, key: spark.createDataFrame([(i, texts[i] if ordered else sets[i]) for i in ids], f"{key} long, x {'array<array<int>>' if ordered else 'array<int>'}")
    e = [ranker.embeddings(lists(ids, key), key, m, "x") for ids, key in ((range(50), "poi_id"), (range(50, 60), "query_id"))]
    got = ranker.rank(poi, q, bits(range(50), "poi_id"), bits(range(50, 60), "query_id"), *e, m, k=7).collect()
    embed = [m.embed_sequence(t) if ordered else m.embed(np.array(s, int)) for t, s in zip(texts, sets, strict=True)]
    for a in range(50, 60):
        t = []
        for b in range(50):
            x = np.maximum(np.concatenate((embed[a], embed[b])), 0)
            for w, c in m.layers:
                x = np.maximum(w @ x + c, 0)
            both = [float(m.bits[k] @ x) for k in set(sets[a]) & set(sets[b])]
            t.append(sum((v if v > 0 else v / 8) + 1 for v in both) / max(1, len(sets[a])))
        z = (np.array(t) - np.mean(t)) / (np.std(t, ddof=1) + 1e-6)
        s = [(1 - 1 / (1 + math.exp(-z[b]))) * -math.log(1 + math.dist(xy[a], xy[b])) for b in range(50)]
        want = sorted(range(50), key=lambda b: (-round(s[b], 9), b))[:7]
        assert [x["poi_id"] for x in sorted((x for x in got if x["query_id"] == a), key=lambda x: x["rank"])] == want


def test_ranker_makes_no_row_for_a_pair(spark, world):
    """Two passes over the places; sequences in one matrix are those taken one by one, as are the words' bits made in batches."""
    poi, q, pb, qb = world
    m = ranker.Ranker.random(bloom.SLICES * bloom.BITS, 6, 5, ordered=True)
    words = bloom.sequences(poi.select("poi_id", "text"), "text", most=2)
    assert sorted(words.collect()) == sorted(poi.select("poi_id", bloom.sequence(text.words(F.col("text")), most=2)).collect())
    lists = [[[1, 9], [4], [4, 7, 1]], [], None, [[3, 3]] * 50, [[2]]]
    import pyarrow as pa

    assert np.allclose(m.embed_sequences(pa.array(lists, pa.list_(pa.list_(pa.int32())))), [m.embed_sequence(x or []) for x in lists])
    e = ranker.embeddings(words, "poi_id", m, "words"), ranker.embeddings(bloom.sequences(q.select("query_id", "text"), "text"), "query_id", m, "words")
    out = ranker.rank(bloom.filters(poi, "text"), q, pb, qb, *e, m, k=5)
    assert out.count() == 15 and "Generate" not in out._jdf.queryExecution().toString()


def test_bm25_makes_no_row_for_a_posting(spark, world):
    poi, q, _, _ = world
    for made in (lexical.bm25_topk(poi, q, 7), lexical.bm25_distance_topk(poi, q, 7)):
        assert made.count() == 21 and "Generate" not in made._jdf.queryExecution().toString()
    df = {r["term"]: r["df"] for r in lexical.statistics(poi).collect()}
    texts = [set(r["text"].split()) for r in poi.collect()]
    assert df == {w: sum(w in t for t in texts) for w in set().union(*texts)}
    pairs = {(r["query_id"], r["poi_id"]) for r in lexical.bm25_pairs(poi, q).collect()}
    assert pairs == {(a["query_id"], b["poi_id"]) for a in q.collect() for b in poi.collect() if set(a["text"].split()) & set(b["text"].split())}


def test_convolution_by_the_book():
    m = ranker.Ranker.random(16, 3, 2, seed=1, ordered=True)
    m.length = 6
    words = [[1, 2], [3], [5, 6, 7]]
    x = np.zeros((6, 3))
    for k, w in enumerate(words):
        x[k] = m.encoder[w].sum(axis=0)
    y = x
    for w, b in m.convs:
        y = np.array([[max(0, b[o] + sum(w[o, c, k] * y[t + k - 2, c] for k in range(5) for c in range(3) if 0 <= t + k - 2 < 6)) for o in range(3)] for t in range(6)])
    assert np.allclose(m.embed_sequence(words), (x + y).mean(axis=0))


def test_training_the_ranker(spark):
    r, m = np.random.default_rng(4), ranker.Ranker.random(20, 4, 3, seed=5)
    fusion = np.array([1.2, 0.1, 1.0, 0.2])
    query, places = np.array([1, 4, 7, 9]), [np.sort(r.choice(20, 6, replace=False)) for _ in range(5)]
    near, positive = -r.uniform(0, 4, 5), np.array([True, False, False, True, False])
    _, loss, grad = training.slate_gradient(m, fusion, query, places, near, positive)
    for k, x in enumerate(training.parameters(m, fusion)):
        for at in list(np.ndindex(x.shape))[:: max(1, x.size // 9)]:
            values = [y.copy() for y in training.parameters(m, fusion)]
            values[k][at] += 1e-6
            up = training.slate_gradient(*training.with_parameters(m, values), query, places, near, positive)[1]
            assert abs((up - loss) / 1e-6 - grad[k][at]) < 1e-3
    rows = [(q, [int(b) for b in query], [int(b) for b in np.sort(r.choice(20, 6, replace=False))], float(-r.uniform(0, 4)), int(k == 0)) for q in range(8) for k in range(5)]
    _, fused, losses = training.fit_ranker(spark.createDataFrame(rows, "query_id long, q_bits array<int>, p_bits array<int>, near double, label int"), m, steps=12, rate=0.03)
    assert losses[-1] < losses[0] and set(fused) == set("abcd")


def test_loss_golden_and_by_depth(spark):
    """Three items: scores 2, 1, .5, labels 0, 1, 0. All nine pairs count, weighed by the first one's gain over its discount: only the second has a gain, 1, over log2(3)."""
    rows = [(1, k, s, y) for k, (s, y) in enumerate([(2.0, 0), (1.0, 1), (0.5, 0)])]
    slates = spark.createDataFrame(rows, "query_id long, item long, score double, label int")
    got = metrics.lambda_loss(slates, scheme="ndcgLoss1").first()
    want = sum(-math.log2(1 / (1 + math.exp(-(1.0 - s)))) / math.log2(3) for s in (2.0, 1.0, 0.5))
    assert got["pairs"] == 9 and abs(got["loss"] - want) < 1e-9
    plain = metrics.lambda_loss(slates).first()
    assert plain["pairs"] == 2 and abs(plain["loss"] - 2.5785846) < 1e-6
    both = slates.selectExpr("0 AS depth", "*").unionByName(slates.selectExpr("1 AS depth", "*"))
    assert {(r["depth"], r["pairs"], r["weighted"]) for r in metrics.by_depth(both, [0.5]).collect()} == {(0, 2, 1.289292), (1, 2, 2.578585)}


def test_bm25_has_all_hundred(spark):
    poi = spark.createDataFrame([(i, "red house" if i % 7 == 0 else f"other{i}", float(i), 0.0) for i in range(50)], "poi_id long, text string, x double, y double")
    q = spark.createDataFrame([(0, "red", 0.0, 0.0), (1, "nothing here", 0.0, 0.0)], "query_id long, text string, x double, y double")
    rows = lexical.bm25_topk(poi, q, 20).collect()
    first = [r["poi_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == 0]
    assert first == [*range(0, 50, 7), *[i for i in range(50) if i % 7][:12]]
    assert [r["poi_id"] for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == 1] == list(range(20))
    assert lexical.bm25_topk(poi, q, 100).count() == 100
    upper = lambda c: F.split(F.upper(c), " ")
    assert lexical.bm25_topk(poi, q, 5, tokenizer=upper).count() == 10


def test_more_chunks_than_a_cell_had_room_for(spark, monkeypatch):
    monkeypatch.setattr(tree, "CELL", 2)
    poi = spark.createDataFrame([(i, float(i % 3) * 0.001, float(i // 100 == 4) * 900) for i in range(500)], "poi_id long, x double, y double")
    e = tree.grouped(tree.leaves(poi))
    per = [r["count"] for r in e.groupBy("parent_id").count().collect()]
    assert sum(per) == 500 and max(per) <= 8 and len(per) >= 63


def test_tree_by_clusters(spark):
    r = np.random.default_rng(2)
    spots = r.uniform(0, 1000, (120, 2)).round(1)
    poi = spark.createDataFrame([(i, *map(float, spots[i % 120])) for i in range(700)] + [(700 + i, 5000.0 + i, 5000.0) for i in range(2)], "poi_id long, x double, y double")
    node, edges, _ = tree.build(poi, None, levels=2, merge_small=True, by="kmeans")
    e = edges.collect()
    leaves = [x["child_id"] for x in e if x["depth"] == 1]
    assert sorted(leaves) == list(range(702))
    parents = {x["parent_id"] for x in e if x["depth"] == 1}
    assert {x["child_id"] for x in e if x["depth"] == 0} == parents
    sizes = [sum(x["parent_id"] == p and x["depth"] == 1 for x in e) for p in parents]
    assert min(sizes) >= 3 and max(sizes) <= 16
    wide = node.where("depth = 1").agg(F.avg("radius")).first()[0]
    assert wide < 150  # places of a node lie together: the box has a diagonal of 1,400
    assert tree.lloyd(np.array([[0.0, 0], [0, 1], [9, 9], [9, 8]]), 2).tolist() == [0, 0, 1, 1]


def test_training_lowers_the_loss(spark):
    r = np.random.default_rng(1)
    rows = [(q, float(z), float(n), int(k == 0)) for q in range(30) for k, (z, n) in enumerate(zip(r.normal(0, 1, 8) + np.eye(8)[0] * 2, -r.uniform(0, 5, 8), strict=True))]
    p, losses = training.fit_fusion(spark.createDataFrame(rows, "query_id long, z double, near double, label int"), steps=40)
    assert losses[-1] < losses[0] and set(p) == set("abcd")


def test_datasets(spark):
    q = spark.createDataFrame([(0, "a", 0.0, 0.0, [1]), (1, "b", 1.0, 1.0, [2]), (2, "c", 2.0, 2.0, [1, 2])], "query_id long, text string, x double, y double, truths array<long>")
    poi = spark.createDataFrame([(i, f"p{i}", float(i), 0.0) for i in range(8)], "poi_id long, text string, x double, y double")
    neg = spark.createDataFrame([(k, r, i) for k in (0, 1) for r, i in enumerate((3, 1, 4, 5, 6, 7), 1)], "query_id long, neg_rank int, poi_id long")
    sub, places = datasets.subset(q, poi, neg, n=10)
    assert sub.count() == 2 and places.count() == 10
    got = {r["poi_id"]: r["text"] for r in places.collect()}
    assert sorted(got) == list(range(10)) and {got[r["truths"][0]] for r in sub.collect()} == {"p1", "p2"}
    mapping = spark.createDataFrame([(1, 10), (2, -1)], "old_id long, new_id long")
    assert {(r["query_id"], tuple(r["truths"])) for r in datasets.remapped(q, mapping).collect()} == {(0, (10,)), (2, (10,))}
    assert sorted(r[0] for r in datasets.every_truth(q, q).collect()) == [1, 2]
    c = datasets.resolve(q, poi, radius=3.0, k=2)
    rec = datasets.candidate_records(c, poi, done=spark.createDataFrame([(2,)], "query_id long"))
    assert {r["query_id"] for r in rec.collect()} == {0, 1} and all(r["selected"] == r["index"][0] for r in rec.collect())
    t = q.select("query_id", F.explode("truths").alias("poi_id"))
    assert datasets.training_groups(q, t, neg.select("query_id", "poi_id"), poi).count() == 16


def test_synthetic(spark):
    q, poi = datasets.synthetic(spark, 50, 4)
    assert q.count() == 50 and poi.count() == 250 and poi.select("poi_id").distinct().count() == 250
    near = q.select(F.explode("truths").alias("poi_id"), F.col("x").alias("qx"), F.col("y").alias("qy")).join(poi, "poi_id")
    assert near.where("abs(x - qx) > 100 or abs(y - qy) > 100").isEmpty()


def test_portions_are_nested(spark):
    rows = datasets.portions(spark.range(1000), "id", [0.02, 0.3]).collect()
    small, large = ({r["id"] for r in rows if r["share"] == s} for s in (0.02, 0.3))
    assert len(small) == 20 and len(large) == 300 and small < large


def test_logs(spark):
    lines = ["ninja: no work to do.", "Epoch=0", "retrieve loss=0.5", "rank loss=0.25", "Dev NDCG @ 5: 0.4", "Epoch=1", "Dev NDCG @ 5: 0.5", "ninja: no work to do.", "Epoch=0", "Dev NDCG @ 5: 0.6"]
    log = report.training_log(spark.createDataFrame(list(enumerate(lines)), "line_no long, line string"))
    got = sorted((r["run"], r["epoch"], r["name"], r["value"]) for r in log.collect())
    assert (1, 0, "rank_loss", 0.25) in got and (2, 0, "dev_ndcg_5", 0.6) in got and len(got) == 5
    c = {(r["epoch"], r["name"]): (r["mean"], r["std"], r["runs"]) for r in report.curves(log).collect()}
    assert c[0, "dev_ndcg_5"][0] == 0.5 and round(c[0, "dev_ndcg_5"][1], 9) == 0.1 and c[0, "dev_ndcg_5"][2] == 2
    result = ["Recall@20: 0.8\tRecall@10: 0.7\tNDCG@5: 0.6\tNDCG@1: 0.5", "Best dev time: 1m (60.5 s)", "Recall@20: 0.6\tRecall@10: 0.7\tNDCG@5: 0.6\tNDCG@1: 0.5"]
    runs = report.result_log(spark.createDataFrame(list(enumerate(result)), "line_no long, line string"))
    s = report.run_summary(runs, ["recall_20", "seconds"]).first()
    assert (s["recall_20_mean"], s["recall_20_std"], s["seconds_mean"], s["runs"]) == (0.7, 0.1, 60.5, 2)
    assert report.throughput(spark.createDataFrame([(2.0,), (2.0,)], "seconds double"), 8).first()["qps"] == 2


def test_cases(spark):
    r, t = ranked(spark, {0: [1, 2], 1: [1, 2], 2: [1, 2]}, {0: [1], 1: [2], 2: [9]})
    q = spark.createDataFrame([(k, "q", 0.0, 0.0) for k in range(3)], "query_id long, text string, x double, y double")
    poi = spark.createDataFrame([(1, "one", 3.0, 4.0), (2, "two", 0.0, 0.0)], "poi_id long, text string, x double, y double")
    c = report.cases(q, r, t)
    assert [(x["case"], x["ahead"]) for x in c.orderBy("query_id").collect()] == [("success", 0), ("top20", 1), ("fail", 20)]
    lines = {x["query_id"]: x["lines"] for x in report.case_lines(c, q, r, poi).collect()}
    assert "1. one (5.0 away)" in lines[1] and lines[0].count("\n") == 1


def test_embed_and_pool(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    got = dense.embed(rows, lambda ts: np.array([[len(t), 1.0] for t in ts]), "id", "text").orderBy("id").collect()
    assert [r["v"] for r in got] == [[2.0, 1.0], [0.0, 1.0]]
    zero = spark.createDataFrame([(1, [0.0, 0.0], 1), (2, [3.0, 4.0], 1)], "vec_id long, v array<double>, label int")
    assert [r["vec_id"] for r in dense.unit(zero).collect()] == [2]


def test_stream(spark, world, tmp_path):
    poi, q, pb, _ = world
    q.write.parquet(str(tmp_path / "in"))
    got = []
    run = streaming.searched(streaming.query_stream(spark, str(tmp_path / "in")), poi, pb, lambda df, n: got.extend(df.collect()), k=10, checkpoint=str(tmp_path / "ck"))
    run.awaitTermination(120)
    assert run.exception() is None
    assert sorted((r["query_id"], r["rank"], r["poi_id"]) for r in got) == brute(world, 10)
