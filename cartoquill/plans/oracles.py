"""DuckDB SQL that states the same results as the queries, by plainer means."""

from __future__ import annotations

XY = "(({k} * 7919) % 10000)::DOUBLE AS x, (({k} * 104729) % 10000)::DOUBLE AS y"
POI = f"poi AS (SELECT doc_id AS poi_id, text, {XY.format(k='doc_id')} FROM documents)"
QUERY = "q AS (SELECT item_id AS query_id, text, ((item_id * 6101 + 17) % 10000)::DOUBLE AS x, ((item_id * 3571 + 29) % 10000)::DOUBLE AS y FROM benchmark)"
SETS = f"{POI}, {QUERY}"
WORDS = r"list_filter(regexp_split_to_array(lower({c}), '\s+'), lambda w: w <> '')"
NGRAMS = "list_distinct(list_concat(list_transform(range(1, len({c}) + 1), lambda i: substr({c}, i, 1)), list_transform(range(1, len({c})), lambda i: substr({c}, i, 2))))"


def _bits(name: str, source: str, key: str) -> str:
    word = f"SELECT {key}, unnest(list_distinct({WORDS.format(c='text')})) AS w FROM {source}"
    return f"{name} AS (SELECT DISTINCT {key}, unnest([('0x' || substr(md5(w), 1, 4))::INT % 8192, ('0x' || substr(md5(w), 5, 4))::INT % 8192 + 8192]) AS bit FROM ({word}))"


PB, QB = _bits("pb", "poi", "poi_id"), _bits("qb", "q", "query_id")
TRUTH = "truth AS (SELECT query_id, poi_id FROM poi JOIN q ON contains(poi.text, q.text))"
OVERLAP = "ov AS (SELECT query_id, poi_id, count(*) AS overlap FROM pb JOIN qb USING (bit) GROUP BY ALL)"


def _fused(text: str = "overlap", radius: str = "0", dist: str = "dist") -> str:
    z = f"(({text}) - mean) / (CASE WHEN coalesce(dev, 0) = 0 THEN 1 ELSE dev END)"
    return f"(1 - 1 / (1 + exp(-({z})))) * (-ln(1 + greatest(0, {dist} - {radius})) - 1)"


def _exhaustive(k: int, queries: str = "q", bits: str = "qb") -> str:
    return f"""
ov AS (SELECT query_id, poi_id, count(*) AS overlap FROM pb JOIN {bits} USING (bit) GROUP BY ALL),
pairs AS (SELECT query_id, poi_id, coalesce(overlap, 0) AS overlap, sqrt((q.x - poi.x) ** 2 + (q.y - poi.y) ** 2) AS dist FROM {queries} AS q CROSS JOIN poi LEFT JOIN ov USING (query_id, poi_id)),
stats AS (SELECT *, avg(overlap) OVER (PARTITION BY query_id) AS mean, stddev_samp(overlap) OVER (PARTITION BY query_id) AS dev FROM pairs),
scored AS (SELECT query_id, poi_id, overlap, {_fused()} AS s FROM stats),
found AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, poi_id)::INT AS rank, poi_id, overlap, round(s, 6) AS score FROM scored QUALIFY rank <= {k})"""


def _level(out: str, source: str, bits: str) -> str:
    """Edges, nodes and filters of the level above."""
    cell = lambda c: f"coalesce(least(floor((c{c} - {c}0) / nullif({c}1 - {c}0, 0) * g), g - 1), 0)::BIGINT"
    return f"""
e{out} AS (SELECT cell * 1048576 + (place // 8) AS parent_id, (place % 8)::INT AS child_pos, node_id AS child_id, min_x, max_x, min_y, max_y FROM (
 SELECT *, row_number() OVER (PARTITION BY cell ORDER BY cx, cy, node_id) - 1 AS place FROM (
  SELECT *, {cell('x')} * g + {cell('y')} AS cell FROM {source}, (SELECT min(cx) AS x0, max(cx) AS x1, min(cy) AS y0, max(cy) AS y1, greatest(1, ceil(sqrt(count(*) / 16.0)))::BIGINT AS g FROM {source})))),
n{out} AS (SELECT node_id, (min_x + max_x) / 2 AS cx, (min_y + max_y) / 2 AS cy, sqrt((max_x - min_x) ** 2 + (max_y - min_y) ** 2) / 2 AS radius, min_x, max_x, min_y, max_y FROM (
 SELECT parent_id AS node_id, min(min_x) AS min_x, max(max_x) AS max_x, min(min_y) AS min_y, max(max_y) AS max_y FROM e{out} GROUP BY 1)),
b{out} AS (SELECT DISTINCT parent_id AS node_id, bit FROM {bits} JOIN e{out} ON child_id = node_id)"""


TREE = f"""{POI}, {PB},
n2 AS (SELECT poi_id AS node_id, x AS cx, y AS cy, 0.0::DOUBLE AS radius, x AS min_x, x AS max_x, y AS min_y, y AS max_y FROM poi),
b2 AS (SELECT poi_id AS node_id, bit FROM pb), {_level('1', 'n2', 'b2')}, {_level('0', 'n1', 'b1')}"""
EDGES = "SELECT 0 AS depth, parent_id, child_pos, child_id FROM e0 UNION ALL SELECT 1, parent_id, child_pos, child_id FROM e1"
PATHS = f"""{TRUTH}, paths AS (
 SELECT DISTINCT query_id, 2 AS depth, poi_id AS node_id FROM truth
 UNION SELECT query_id, 1, parent_id FROM truth JOIN e1 ON child_id = poi_id
 UNION SELECT query_id, 0, e0.parent_id FROM truth JOIN e1 ON e1.child_id = poi_id JOIN e0 ON e0.child_id = e1.parent_id)"""


def _beam(d: int, candidates: str) -> str:
    step = f"""
c{d} AS ({candidates}),
s{d} AS (SELECT c.query_id, c.node_id, coalesce(o, 0) AS overlap, radius, sqrt((cx - q.x) ** 2 + (cy - q.y) ** 2) AS dist FROM c{d} AS c JOIN n{d} AS n USING (node_id) JOIN q USING (query_id)
 LEFT JOIN (SELECT query_id, node_id, count(*) AS o FROM c{d} JOIN qb USING (query_id) JOIN b{d} USING (node_id, bit) GROUP BY ALL) USING (query_id, node_id)),
t{d} AS (SELECT *, avg(overlap) OVER (PARTITION BY query_id) AS mean, stddev_samp(overlap) OVER (PARTITION BY query_id) AS dev FROM s{d}),
p{d} AS (SELECT query_id, {d} AS depth, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, node_id)::INT AS rank, node_id, round(s, 6) AS score FROM (SELECT *, {_fused(radius='radius')} AS s FROM t{d}) QUALIFY rank <= 32)"""
    return step


def _children(d: int) -> str:
    return f"SELECT query_id, child_id AS node_id FROM p{d} JOIN e{d} ON parent_id = node_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, child_pos, child_id) <= 32"


BEAM = f"{TREE}, {QUERY}, {QB}, {_beam(0, 'SELECT query_id, node_id FROM q CROSS JOIN n0')}, {_beam(1, _children(0))}, {_beam(2, _children(1))}, beam AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2)"

BM25 = f"""{SETS},
pt AS (SELECT poi_id, len(w) AS dl, unnest(w) AS term FROM (SELECT poi_id, {WORDS.format(c='text')} AS w FROM poi)),
tf AS (SELECT poi_id, dl, term, count(*) AS tf FROM pt GROUP BY ALL),
st AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM poi) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM tf GROUP BY term)),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({WORDS.format(c='text')}) AS term FROM q) GROUP BY ALL),
av AS (SELECT avg(len({WORDS.format(c='text')})) AS avgdl FROM poi),
bm AS (SELECT query_id, poi_id, sum(times * idf * tf * 1.3 / (tf + 0.3 * (1 - 0.1 + 0.1 * dl / avgdl))) AS t FROM tf JOIN qt USING (term) JOIN st USING (term), av GROUP BY ALL),
dn AS (SELECT sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) AS d_norm FROM poi)"""


def _bm25_distance(text: str) -> str:
    return f"""fu AS (SELECT query_id, poi_id, 0.6 * (1 - sqrt((q.x - poi.x) ** 2 + (q.y - poi.y) ** 2) / d_norm) + 0.4 * coalesce({text}, 0) AS s FROM q CROSS JOIN poi CROSS JOIN dn LEFT JOIN bm USING (query_id, poi_id) LEFT JOIN (SELECT query_id, greatest(max(t), 0) AS most FROM bm GROUP BY 1) USING (query_id))"""


def _best(source: str, k: int, item: str = "poi_id", score: str = "s", digits: int = 6) -> str:
    return f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 9) DESC, {item})::INT AS rank, {item}, round({score}, {digits}) AS score FROM {source} QUALIFY rank <= {k}"


HARD = f"""{BM25}, {_bm25_distance('t')}, {TRUTH}, rk AS ({_best('fu', 100)}),
lf AS (SELECT rk.query_id, rk.poi_id, rk.rank FROM rk JOIN poi USING (poi_id) WHERE NOT EXISTS (SELECT 1 FROM truth WHERE truth.query_id = rk.query_id AND truth.poi_id = rk.poi_id)
 AND NOT EXISTS (SELECT 1 FROM truth JOIN poi AS p2 ON p2.poi_id = truth.poi_id WHERE truth.query_id = rk.query_id AND p2.text = poi.text)),
hn AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS neg_rank, poi_id FROM lf QUALIFY neg_rank <= 10)"""

DENSE = f"""v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, {XY.format(k='vec_id')} FROM embeddings),
dq AS (SELECT * FROM v WHERE vec_id % 50 = 0),
cs AS (SELECT dq.vec_id AS query_id, dc.vec_id, dq.label = dc.label AS same, sqrt((dq.x - dc.x) ** 2 + (dq.y - dc.y) ** 2) AS dist, list_inner_product(dq.v, dc.v) / (sqrt(list_inner_product(dq.v, dq.v)) * sqrt(list_inner_product(dc.v, dc.v))) AS s FROM dq JOIN v AS dc ON dq.vec_id <> dc.vec_id),
top AS (SELECT query_id, vec_id, same, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id)::INT AS rank FROM cs QUALIFY rank <= 100),
nt AS (SELECT query_id, count(*) FILTER (same) AS n FROM cs GROUP BY 1),
dd AS (SELECT sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2) AS d_norm FROM v)"""


def _dense_metric(columns: str) -> str:
    return f"WITH {DENSE} SELECT dq.vec_id AS query_id, {columns} FROM dq LEFT JOIN nt ON nt.query_id = dq.vec_id LEFT JOIN top ON top.query_id = dq.vec_id GROUP BY dq.vec_id, n"


def _recall(k: int) -> str:
    return f"coalesce(round(count(*) FILTER (same AND rank <= {k}) / nullif(least(n, {k}), 0), 6), 0)::DOUBLE AS recall_{k}"


def _ndcg(k: int, hit: str = "same", n: str = "n") -> str:
    return f"coalesce(round(sum(1 / log2(rank + 1)) FILTER ({hit} AND rank <= {k}) / list_sum(list_transform(range(1, least({n}, {k}) + 1), lambda i: 1 / log2(i + 1))), 6), 0)::DOUBLE AS ndcg_{k}"


def _mrr(k: int) -> str:
    return f"coalesce(round(1.0 / min(rank) FILTER (same AND rank <= {k}), 6), 0)::DOUBLE AS mrr_{k}"


CUST = f"c AS (SELECT c_custkey AS id, {XY.format(k='c_custkey')} FROM customer), s AS (SELECT s_suppkey AS id, {XY.format(k='s_suppkey')} FROM supplier)"
COARSE = "c AS (SELECT c_custkey AS id, floor(((c_custkey * 7919) % 10000) / 500.0)::DOUBLE AS x, floor(((c_custkey * 104729) % 10000) / 500.0)::DOUBLE AS y FROM customer), l AS (SELECT x, y, count(*) AS n, min(id) AS id, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM c GROUP BY ALL)"
# Places of small locations move to the nearest location of four or more, if there is one.
COARSE_POI = f"{POI}, l AS (SELECT x, y, count(*) AS n, min(poi_id) AS id FROM poi GROUP BY ALL), h AS (SELECT a.x, a.y, b.x AS hx, b.y AS hy FROM l AS a JOIN l AS b ON a.n < 4 AND b.n >= 4 QUALIFY row_number() OVER (PARTITION BY a.x, a.y ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id) = 1), sp AS (SELECT poi_id, coalesce(hx, x) AS x, coalesce(hy, y) AS y FROM poi LEFT JOIN h USING (x, y))"
SHUFFLED = "sh AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || '-0'), o_orderkey) AS place, count(*) OVER () AS n FROM orders)"
LINES = "ln AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no FROM events)"
SLATE = f"{SETS}, {PB}, {QB}, {_exhaustive(50)}, cand AS (SELECT query_id, rank, poi_id, x, y FROM found JOIN poi USING (poi_id)), {TRUTH}"

_LOSS = "greatest(pow(greatest(1 / (1 + exp(-(a.s - b.s))), 1e-10), {w}), 1e-10)"
_GAP = "abs(1 / log2(1 + abs(a.rank - b.rank)) - 1 / log2(2 + abs(a.rank - b.rank)))"
_GAINS = "abs(a.g - b.g)"
_RANKS = "abs(1 / log2(1 + a.rank) - 1 / log2(1 + b.rank))"
_SCHEMES = (("none", "sum", "1"), ("none", "mean", "1"), ("lambdaRank", "sum", f"{_RANKS} * {_GAINS}"), ("ndcgLoss1", "sum", "a.g / log2(1 + a.rank)"), ("ndcgLoss2", "sum", f"{_GAP} * {_GAINS}"), ("ndcgLoss2PP", "sum", f"(10 * {_GAP} + {_RANKS}) * {_GAINS}"), ("rankNetWeightedByGTDiff", "mean", "abs(a.y - b.y)"))

POSITIVE = f"""{DENSE}, fp AS (SELECT query_id, min(vec_id) AS vec_id FROM cs WHERE same GROUP BY 1),
pr AS (SELECT query_id, vec_id, s, ln(sum(exp(s - m)) OVER (PARTITION BY query_id)) + m AS lse, rank() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC) AS rank FROM (SELECT *, max(s) OVER (PARTITION BY query_id) AS m FROM cs)),
ps AS (SELECT query_id, vec_id AS item, lse - s AS nll, rank, (rank = 1)::INT AS hit FROM pr JOIN fp USING (query_id, vec_id))"""

ORACLES: dict[str, str] = {
    "ngram_tokens": f"WITH {QUERY}, c AS (SELECT query_id, lower(trim(text)) AS t FROM q) SELECT query_id, unnest({NGRAMS.format(c='t')}) AS token FROM c",
    "query_tokens": f"WITH {QUERY}, c AS (SELECT query_id, lower(trim(text)) AS t, {WORDS.format(c='text')} AS w FROM q) SELECT query_id, unnest(list_distinct(list_concat({NGRAMS.format(c='t')}, w))) AS token FROM c",
    "poi_hybrid_tokens": f"""WITH {POI}, f AS (SELECT poi_id, string_split(lower(text), ',') AS f FROM poi), g AS (SELECT poi_id, trim(f[1]) AS a, trim(coalesce(f[2], '')) AS b, {WORDS.format(c="replace(array_to_string(f, ' , '), ' , ', ' ')")} AS w FROM f),
t AS (SELECT poi_id, list_sort(list_distinct(list_concat({NGRAMS.format(c='a')}, {NGRAMS.format(c='b')}, w))) AS t FROM g) SELECT poi_id, len(t)::INT AS n_tokens, md5(array_to_string(t, '|')) AS digest FROM t""",
    "regex_tokens": r"""WITH t AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]'), lambda x: lower(x)) AS t FROM conversations)
SELECT conv_id, turn, len(t)::INT AS n_tokens, array_to_string(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])), '|') AS ngrams FROM t""",
    "normal_documents": "WITH a AS (SELECT doc_id, replace(replace(text, chr(10), ' '), '’', '''') AS t FROM documents), b AS (SELECT doc_id, CASE WHEN starts_with(t, '\"') THEN substr(t, 2) ELSE t END AS t FROM a) SELECT doc_id, md5(CASE WHEN ends_with(t, '\"') THEN substr(t, 1, len(t) - 1) ELSE t END) AS digest FROM b",
    "bloom_bits_md5": f"WITH {QUERY}, {QB} SELECT query_id, bit FROM qb",
    "bloom_sequences": f"WITH {QUERY}, w AS (SELECT query_id, {WORDS.format(c='text')}[1:40] AS w FROM q), u AS (SELECT query_id, (generate_subscripts(w, 1) - 1)::INT AS place, unnest(w) AS w FROM w) SELECT query_id, place, ('0x' || substr(md5(w), 1, 4))::INT % 8192 AS bit_0, ('0x' || substr(md5(w), 5, 4))::INT % 8192 + 8192 AS bit_1 FROM u",
    "bloom_overlap": f"WITH {SETS}, {PB}, {QB}, {OVERLAP} SELECT * FROM ov",
    "bloom_unmatched": f"""WITH {SETS}, {PB}, {QB}, {TRUTH},
pairs AS (SELECT query_id, poi_id FROM truth UNION SELECT query_id, poi_id FROM (SELECT query_id, poi_id FROM q CROSS JOIN poi QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sqrt((q.x - poi.x) ** 2 + (q.y - poi.y) ** 2), poi_id) <= 10))
SELECT query_id, poi_id, count(*) AS n_unmatched FROM pairs JOIN qb USING (query_id) ANTI JOIN pb USING (poi_id, bit) GROUP BY ALL""",
    "bloom_xor": f"""WITH t AS (SELECT conv_id, turn // 2 AS pair, min(text) FILTER (turn % 2 = 0) AS a, min(text) FILTER (turn % 2 = 1) AS b FROM conversations GROUP BY ALL),
w AS (SELECT conv_id, pair, 0 AS k, unnest({WORDS.format(c="coalesce(a, '')")}) AS w FROM t UNION SELECT conv_id, pair, 1, unnest({WORDS.format(c="coalesce(b, '')")}) FROM t),
x AS (SELECT DISTINCT conv_id, pair, k, unnest([('0x' || substr(md5(w), 1, 4))::INT % 8192, ('0x' || substr(md5(w), 5, 4))::INT % 8192 + 8192]) AS bit FROM w),
y AS (SELECT conv_id, pair, bit FROM x GROUP BY ALL HAVING count(*) = 1) SELECT t.conv_id, t.pair, count(bit)::INT AS n_xor FROM t LEFT JOIN y USING (conv_id, pair) GROUP BY ALL""",
    "bbox_dnorm": f"WITH {POI} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, round(sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2), 6) AS d_norm FROM poi",
    "distance_topk": f"WITH {SETS}, d AS (SELECT query_id, poi_id, sqrt((q.x - poi.x) ** 2 + (q.y - poi.y) ** 2) AS d FROM q CROSS JOIN poi) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY d, poi_id)::INT AS rank, poi_id, round(d, 6) AS dist FROM d QUALIFY rank <= 20",
    "unsup_exhaustive_topk": f"WITH {SETS}, {PB}, {QB}, {_exhaustive(20)} SELECT * FROM found",
    "thinned_search_quality": f"""WITH {SETS}, tq AS (SELECT query_id, x, y, array_to_string(list_filter({WORDS.format(c='text')}, lambda w: ('0x' || substr(md5(w || query_id), 9, 4))::INT % 8 = 0), ' ') AS text FROM q), {PB}, {_bits('tb', 'tq', 'query_id')}, {_exhaustive(20, 'tq', 'tb')}, {TRUTH},
nt AS (SELECT query_id, count(*) AS n FROM truth GROUP BY 1), h AS (SELECT query_id, rank, poi_id IN (SELECT poi_id FROM truth WHERE truth.query_id = found.query_id) AS same FROM found),
per AS (SELECT q.query_id, coalesce(count(*) FILTER (same) / least(n, 20), 0) AS r, coalesce(sum(1 / log2(rank + 1)) FILTER (same AND rank <= 5) / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 0) AS g, coalesce(1.0 / min(rank) FILTER (same), 0) AS m FROM q LEFT JOIN nt USING (query_id) LEFT JOIN h USING (query_id) GROUP BY q.query_id, n)
SELECT round(avg(r), 6) AS recall_20, round(avg(g), 6) AS ndcg_5, round(avg(m), 6) AS mrr_20, count(*) AS n_queries FROM per""",
    "tree_nodes": f"WITH {TREE} " + " UNION ALL ".join(f"SELECT {d} AS depth, node_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("cx", "cy", "radius", "min_x", "max_x", "min_y", "max_y")) + f" FROM n{d}" for d in range(3)),
    "tree_edges": f"WITH {TREE} {EDGES}",
    "tree_node_bits": f"WITH {TREE} " + " UNION ALL ".join(f"SELECT {d} AS depth, node_id, count(*) AS n_bits, sum(bit)::BIGINT AS sum_bits FROM b{d} GROUP BY node_id" for d in range(3)),
    "tree_density": f"WITH {TREE} " + " UNION ALL ".join(f"SELECT {d} AS depth, count(*) AS n_nodes, max(n) AS max_bits, round(avg(n), 6) AS avg_bits, avg(n) / 16384 > 0.05 AS dense FROM (SELECT count(*) AS n FROM b{d} GROUP BY node_id)" for d in range(3)),
    "tree_sizes": f"WITH {TREE} " + " UNION ALL ".join(f"SELECT {d} AS depth, count(*) AS n_bits, round(count(*) * 2 / 1e6, 6) AS megabytes FROM b{d}" for d in range(3)),
    "tree_truth_paths": f"WITH {TREE}, {QUERY}, {PATHS} SELECT * FROM paths",
    "beam_search_topk": f"WITH {BEAM} SELECT query_id, rank, node_id AS poi_id, score FROM p2 WHERE rank <= 20",
    "beam_candidates": f"WITH {BEAM} SELECT * FROM beam",
    "beam_intermediate_recall": f"WITH {BEAM}, {PATHS}, h AS (SELECT query_id, depth, count(*) AS h FROM beam SEMI JOIN paths USING (query_id, depth, node_id) GROUP BY ALL), n AS (SELECT query_id, depth, count(*) AS n FROM paths GROUP BY ALL) SELECT depth, round(avg(coalesce(h / n, 0)), 6) AS recall FROM q CROSS JOIN (SELECT unnest([0, 1, 2]) AS depth) LEFT JOIN n USING (query_id, depth) LEFT JOIN h USING (query_id, depth) GROUP BY depth",
    "nnue_zero_weight_equiv": f"WITH {BEAM} SELECT query_id, rank, node_id AS poi_id, score FROM p2 WHERE rank <= 20",
    "ranker_zero_weight": f"""WITH {SETS}, {PB}, {QB}, ov AS (SELECT query_id, poi_id, count(*) AS n FROM pb JOIN qb USING (bit) GROUP BY ALL), qn AS (SELECT query_id, count(*) AS m FROM qb GROUP BY 1),
pairs AS (SELECT query_id, poi_id, coalesce(n / m, 0) AS t, sqrt((q.x - poi.x) ** 2 + (q.y - poi.y) ** 2) AS dist FROM q CROSS JOIN poi LEFT JOIN qn USING (query_id) LEFT JOIN ov USING (query_id, poi_id)),
sc AS (SELECT query_id, poi_id, (1 - 1 / (1 + exp(-(t - avg(t) OVER w) / (coalesce(stddev_samp(t) OVER w, 0) + 1e-6)))) * -ln(1 + dist) AS s FROM pairs WINDOW w AS (PARTITION BY query_id)) {_best('sc', 20)}""",
    "kmeans_tree_cover": f"WITH {COARSE_POI} SELECT depth, count(*) AS n_paths, count(DISTINCT poi_id) AS n_leaves, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM sp, (SELECT unnest([0, 1])::INT AS depth) GROUP BY depth",
    "dataset_file": f"WITH {SETS}, {PB}, {TRUTH}, b AS (SELECT poi_id, count(*) AS n, sum(bit) AS s FROM pb GROUP BY 1), t AS (SELECT poi_id, count(*) AS n FROM truth GROUP BY 1) SELECT row_number() OVER (ORDER BY poi_id) - 1 AS id, coalesce(b.n, 0)::INT AS n_bits, coalesce(b.s, 0)::BIGINT AS sum_bits, x, y, coalesce(t.n, 0)::INT AS n_truths FROM poi LEFT JOIN b USING (poi_id) LEFT JOIN t USING (poi_id)",
    "tree_file": f"WITH {TREE} SELECT 0 AS depth, dense_rank() OVER (ORDER BY parent_id) - 1 AS parent_id, child_pos, dense_rank() OVER (ORDER BY child_id) - 1 AS child_id FROM e1 UNION ALL SELECT 1, dense_rank() OVER (ORDER BY parent_id) - 1, child_pos, dense_rank() OVER (ORDER BY child_id) - 1 FROM e0",
    "candidate_file": f"WITH {BEAM}, nm AS (" + " UNION ALL ".join(f"SELECT {d} AS depth, node_id, row_number() OVER (ORDER BY node_id) - 1 AS number FROM n{d}" for d in range(3)) + "), qn AS (SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS k FROM (SELECT DISTINCT query_id FROM beam)) SELECT k::BIGINT AS query_id, depth, rank, number AS node_id FROM beam JOIN nm USING (depth, node_id) JOIN qn USING (query_id)",
    "slate_labels": f"WITH {BEAM}, {PATHS} SELECT query_id, depth, rank, node_id, ((query_id, depth, node_id) IN (SELECT (query_id, depth, node_id) FROM paths))::INT AS label FROM beam",
    "context_partner": f"""WITH {SLATE}, sel AS (SELECT query_id, poi_id, rank, x, y, coalesce(overlap, 0) AS shared FROM cand LEFT JOIN ov USING (query_id, poi_id)),
pt AS (SELECT a.query_id, a.poi_id, b.poi_id AS partner_id FROM sel AS a JOIN sel AS b ON a.query_id = b.query_id AND a.poi_id <> b.poi_id AND b.rank <= 30 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 3000 QUALIFY row_number() OVER (PARTITION BY a.query_id, a.poi_id ORDER BY b.shared DESC, b.poi_id) = 1),
cv AS (SELECT query_id, poi_id, count(*) AS n FROM pt JOIN qb USING (query_id) ANTI JOIN pb USING (poi_id, bit) SEMI JOIN pb AS pp ON pp.poi_id = partner_id AND pp.bit = qb.bit GROUP BY ALL)
SELECT query_id, poi_id, partner_id, coalesce(n, 0) AS covered FROM pt LEFT JOIN cv USING (query_id, poi_id)""",
    "context_target": f"""WITH {SLATE}, ft AS (SELECT query_id, arg_min(poi_id, rank) AS truth, arg_min(x, rank) AS tx, arg_min(y, rank) AS ty FROM cand SEMI JOIN truth USING (query_id, poi_id) GROUP BY 1),
lk AS (SELECT query_id, bit FROM (SELECT query_id, truth AS poi_id FROM ft) JOIN qb USING (query_id) ANTI JOIN pb USING (poi_id, bit)),
hd AS (SELECT query_id FROM lk GROUP BY 1 HAVING count(*) * 2 >= (SELECT count(*) FROM qb WHERE qb.query_id = lk.query_id)),
cv AS (SELECT query_id, poi_id, count(*) AS n FROM cand JOIN lk USING (query_id) JOIN pb USING (poi_id, bit) GROUP BY ALL)
SELECT query_id, poi_id, CASE WHEN truth IS NOT NULL AND query_id IN (SELECT query_id FROM hd) AND sqrt((x - tx) ** 2 + (y - ty) ** 2) <= 3000 THEN coalesce(n, 0) ELSE -1 END AS target FROM cand LEFT JOIN ft USING (query_id) LEFT JOIN cv USING (query_id, poi_id)""",
    "bm25_stats": f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM st",
    "bm25_topk": f"WITH {BM25}, al AS (SELECT query_id, poi_id, coalesce(t, 0) AS t FROM q CROSS JOIN poi LEFT JOIN bm USING (query_id, poi_id)) {_best('al', 100, score='t', digits=4)}",
    "bm25_d_topk": f"WITH {BM25}, {_bm25_distance('t / (most + 1e-6)')} {_best('fu', 100)}",
    "hard_negatives": f"WITH {HARD} SELECT * FROM hn",
    "cosine_topk": f"WITH {DENSE} {_best('cs', 100, 'vec_id')}",
    "cosine_d_max": f"WITH {DENSE}, fu AS (SELECT query_id, vec_id, 0.6 * (1 - dist / d_norm) + 0.4 * s / (max(s) OVER (PARTITION BY query_id) + 1e-6) AS s FROM cs, dd) {_best('fu', 100, 'vec_id')}",
    "cosine_d_minmax": f"WITH {DENSE}, fu AS (SELECT query_id, vec_id, 0.2 * (1 - dist / d_norm) + 0.8 * (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) AS s FROM cs, dd WINDOW w AS (PARTITION BY query_id)) {_best('fu', 100, 'vec_id')}",
    "recall_at_k": _dense_metric(f"{_recall(10)}, {_recall(20)}"),
    "ndcg_at_k": _dense_metric(f"{_ndcg(1)}, {_ndcg(5)}"),
    "mrr_at_k": _dense_metric(f"{_mrr(5)}, {_mrr(20)}"),
    "range_join_2km": f"WITH {CUST} SELECT s.id AS a_id, c.id AS b_id, round(sqrt((s.x - c.x) ** 2 + (s.y - c.y) ** 2), 6) AS dist FROM s JOIN c ON sqrt((s.x - c.x) ** 2 + (s.y - c.y) ** 2) <= 2000",
    "knn_join": f"WITH {CUST}, d AS (SELECT c.id AS a_id, s.id AS b_id, sqrt((s.x - c.x) ** 2 + (s.y - c.y) ** 2) AS d FROM c CROSS JOIN s) SELECT a_id, row_number() OVER (PARTITION BY a_id ORDER BY d, b_id)::INT AS rank, b_id, round(d, 6) AS dist FROM d QUALIFY rank <= 5",
    "nearest_location": f"WITH {CUST}, d AS (SELECT s.id AS a_id, c.id AS b_id, sqrt((s.x - c.x) ** 2 + (s.y - c.y) ** 2) AS d FROM c CROSS JOIN s) SELECT a_id, b_id, round(d, 6) AS dist FROM d QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY d, b_id) = 1",
    "loc_groups_having": f"WITH {COARSE} SELECT x, y, n, ids FROM l WHERE n < 4",
    "snapped_locations": f"WITH {COARSE}, h AS (SELECT a.x, a.y, b.x AS hx, b.y AS hy FROM l AS a JOIN l AS b ON a.n < 4 AND b.n >= 4 QUALIFY row_number() OVER (PARTITION BY a.x, a.y ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id) = 1) SELECT id, coalesce(hx, x) AS x, coalesce(hy, y) AS y FROM c LEFT JOIN h USING (x, y)",
    "entity_resolution_top10": f"""WITH {SETS}, qw AS (SELECT DISTINCT query_id, unnest({WORDS.format(c='text')}) AS w FROM q), pw AS (SELECT DISTINCT poi_id, unnest({WORDS.format(c='text')}) AS w FROM poi),
nr AS (SELECT query_id, poi_id FROM q JOIN poi ON sqrt((q.x - poi.x) ** 2 + (q.y - poi.y) ** 2) <= 2000), cm AS (SELECT query_id, poi_id, count(*) AS n FROM nr JOIN qw USING (query_id) JOIN pw USING (poi_id, w) GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(n, 0) DESC, poi_id)::INT AS rank, poi_id, coalesce(n, 0) AS common FROM nr LEFT JOIN cm USING (query_id, poi_id) QUALIFY rank <= 10""",
    "lambda_loss": f"""WITH {DENSE}, sl AS (SELECT query_id, vec_id, round(s, 6) AS s, same::INT AS y FROM top WHERE rank <= 20),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank, row_number() OVER (PARTITION BY query_id ORDER BY y DESC, vec_id) AS ir FROM sl),
gn AS (SELECT query_id, rank, s, y, (pow(2, y) - 1) / greatest(sum(CASE WHEN ir <= 10 THEN (pow(2, y) - 1) / log2(1 + ir) END) OVER (PARTITION BY query_id), 1e-10) AS g FROM rk),
tp AS (SELECT * FROM gn WHERE rank <= 10) """
    + " UNION ALL ".join(f"SELECT '{n}' AS scheme, '{how}' AS how, round({'sum' if how == 'sum' else 'avg'}(-log2({_LOSS.format(w=w)})), 6) AS loss, count(*)::BIGINT AS pairs FROM tp AS a JOIN tp AS b ON a.query_id = b.query_id{'' if n == 'ndcgLoss1' else ' AND a.y > b.y'}" for n, how, w in _SCHEMES),
    "dpr_nll": f"WITH {POSITIVE} SELECT query_id, item, round(nll, 6) AS nll, rank::INT AS rank, hit FROM ps",
    "avg_rank": f"WITH {POSITIVE} SELECT round(avg(rank), 6) AS avg_rank, sum(hit)::BIGINT AS hits, round(avg(nll), 6) AS nll FROM ps",
    "mean_pool": "WITH u AS (SELECT label, vec_id % 3 <> 0 AS m, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS value FROM embeddings) SELECT label, dim::INT AS dim, round(coalesce(sum(value) FILTER (m), 0) / greatest(count(*) FILTER (m), 1e-9), 6) AS value FROM u GROUP BY ALL",
    "train_portions": f"WITH {SHUFFLED} SELECT share, o_orderkey FROM sh, (SELECT unnest([0.02, 0.1, 0.3, 0.7]::DOUBLE[]) AS share) WHERE place <= floor(n * share + 1e-9)",
    "split_70_10_20": f"WITH {SHUFFLED} SELECT o_orderkey, CASE WHEN place <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN place <= floor(n * 0.8 + 1e-9) THEN 'dev' ELSE 'test' END AS split FROM sh",
    "token_order_subset": f"""WITH {HARD}, one AS (SELECT query_id, min(poi_id) AS truth FROM truth GROUP BY 1 HAVING count(*) = 1), pl AS (SELECT query_id, truth, row_number() OVER (ORDER BY md5(query_id || '-0'), query_id) AS place FROM one QUALIFY place <= 1000),
mb AS (SELECT place, 0 AS pos, truth AS poi_id FROM pl UNION ALL SELECT place, row_number() OVER (PARTITION BY place ORDER BY neg_rank) AS pos, poi_id FROM hn JOIN pl USING (query_id) WHERE poi_id <> truth QUALIFY pos <= 4)
SELECT ((place - 1) * 5 + pos)::BIGINT AS poi_id, x, y, md5(text) AS digest FROM mb JOIN poi USING (poi_id)""",
    "case_analysis": f"WITH {DENSE}, h AS (SELECT query_id, min(rank) AS r FROM top WHERE same AND rank <= 20 GROUP BY 1) SELECT dq.vec_id AS query_id, CASE WHEN r = 1 THEN 'success' WHEN r IS NOT NULL THEN 'top20' ELSE 'fail' END AS \"case\", r AS truth_rank, coalesce(r - 1, 20)::INT AS ahead FROM dq LEFT JOIN h ON h.query_id = dq.vec_id",
    "log_segments": f"WITH {LINES}, r AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY line_no) AS run FROM ln) SELECT user_id, event_id, line_no, run::BIGINT AS run, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, run ORDER BY line_no) AS epoch FROM r",
    "run_summary": "SELECT event_type, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std, count(*) AS runs FROM events GROUP BY 1",
    "best_so_far": f"WITH {LINES} SELECT user_id, event_id, max(value) OVER w AS best, coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM ln WINDOW w AS (PARTITION BY user_id ORDER BY line_no)",
    "durations": "SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, format('{:d}h{:02d}m{:05.2f}s', floor(s / 3600)::INT, floor((s % 3600) / 60)::INT, s % 60) AS duration FROM (SELECT l_shipdate, sum(l_quantity) AS s FROM lineitem GROUP BY 1)",
    "quantize_weights": "WITH u AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS value FROM embeddings) SELECT vec_id, dim::INT AS dim, least(greatest(round_even(value * 64, 0), -127), 127)::INT AS q, (floor(abs(value) * 1000)::BIGINT % 256)::INT AS byte FROM u",
    "activations": "WITH e AS (SELECT event_id, value - 50 AS v FROM events) SELECT event_id, round(1 / (1 + exp(-v)), 6) AS sigmoid, round(greatest(v, 0), 6) AS relu, round(CASE WHEN v < 0 THEN v / 16 ELSE v END, 6) AS leaky, round(least(greatest(v, 0), 1), 6) AS clamp FROM e",
}
