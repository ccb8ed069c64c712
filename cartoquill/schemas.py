"""Schemas of the relations that operators pass on."""

from __future__ import annotations

POI = "poi_id long, text string, x double, y double"
QUERY = "query_id long, text string, x double, y double, truths array<long>"
RESULT = "query_id long, rank int, poi_id long, score double"
BEAM = "query_id long, depth int, rank int, node_id long, score double"
TREE_EDGE = "depth int, parent_id long, child_pos int, child_id long"
NODE = "depth int, node_id long, cx double, cy double, radius double, min_x double, max_x double, min_y double, max_y double"
NODE_BIT = "depth int, node_id long, bit int"
WEIGHTS = "tensor string, depth int, row int, values array<int>"
