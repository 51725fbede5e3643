"""Traversal and path search against brute force on small graphs with cycles, hubs and repeated edges."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from kgspark.operators import entity_match as M
from kgspark.operators import path_search as P
from kgspark.operators import traversal as T
from kgspark.operators.adjacency import Adjacency

TRIPLES = "gid bigint, subj string, rel string, obj string, triple_idx int"
ENT = "qid bigint, gid bigint, pos int, entity string"


def graph(seed, nodes=7, edges=16):
    r = random.Random(seed)
    rows = [(f"n{r.randrange(nodes)}", f"r{r.randrange(3)}", f"n{r.randrange(nodes)}") for _ in range(edges)]
    return rows + [rows[0]]


@pytest.fixture(scope="module")
def world(spark):
    graphs = {g: graph(g) for g in range(4)}
    rows = [(g, s, r, o, i) for g, t in graphs.items() for i, (s, r, o) in enumerate(t)]
    starts = [(g, g, 1, "n0") for g in graphs] + [(g, g, 2, "n1") for g in graphs]
    targets = [(g, g, 1, "n2") for g in graphs] + [(g, g, 2, "n3") for g in graphs]
    return graphs, spark.createDataFrame(rows, TRIPLES).cache(), spark.createDataFrame(starts, ENT), spark.createDataFrame(targets, ENT)


def collect(df, *cols):
    return sorted(tuple(tuple(v) if isinstance(v, list) else v for v in row) for row in df.select(*cols).collect())


@pytest.mark.parametrize("depth, page_rows", [(1, 100), (2, 2), (3, 100), (4, 2)])
def test_simple_paths(world, depth, page_rows):
    graphs, triples, starts, targets = world
    want = set()
    for g, edges in graphs.items():
        def walk(nodes, rels):
            if len(rels) > 0 and nodes[-1] in ("n2", "n3"):
                want.add((g, tuple(nodes), tuple(rels)))
            if len(rels) < depth:
                for s, r, o in edges:
                    if s == nodes[-1] and o not in nodes:
                        walk(nodes + [o], rels + [r])
        for s in ("n0", "n1"):
            walk([s], [])
    got = collect(P.enumerate_simple_paths(starts, targets, triples, depth, page_rows), "qid", "entities", "relations")
    assert got == sorted(want)


@pytest.mark.parametrize("hub_first", [True, False])
def test_a_hub_is_met_from_the_other_end(spark, hub_first):
    star = [("hub", "r", f"x{i}") if hub_first else (f"x{i}", "r", "hub") for i in range(50)]
    tail = [("x7", "s", "y"), ("y", "s", "end")] if hub_first else [("end", "s", "y"), ("y", "s", "x7")]
    t = spark.createDataFrame([(1, *e, i) for i, e in enumerate(star + tail)], TRIPLES)
    s, e = ((spark.createDataFrame([(1, 1, 1, n)], ENT)) for n in (("hub", "end") if hub_first else ("end", "hub")))
    want = [("hub", "x7", "y", "end"), ("r", "s", "s")] if hub_first else [("end", "y", "x7", "hub"), ("s", "s", "r")]
    assert collect(P.enumerate_simple_paths(s, e, t, 3, page_rows=7), "entities", "relations") == [tuple(want)]
    assert collect(P.bfs_paths_undirected(s, e, t, 3, page_rows=7), "entities", "relations") == [tuple(want)]


def test_pages_bound_the_edges_of_a_hub_and_lose_none(spark):
    edges = spark.range(3000).selectExpr("1L gid", "if(id % 3 = 0, 'hub', concat('n', id)) node", "'r' rel", "id next")
    adj = Adjacency(edges, 100)
    sizes = {(r["node"], r["page"]): r["count"] for r in adj.pages.groupBy("node", "page").count().collect()}
    assert max(sizes.values()) < 200 and sum(n == "hub" for n, _ in sizes) == 10
    live = spark.createDataFrame([(1, "hub"), (1, "n1"), (1, "none")], "gid bigint, node string")
    assert adj.step(live).count() == adj.rows_after(live) == 1001
    assert adj.step(live).select("next").distinct().count() == 1001


def test_path_search_of_empty_tables_and_null_ends(spark):
    t = spark.createDataFrame([(1, "a", "r", None, 0), (1, None, "r", "b", 1), (1, "a", "r", "b", 2)], TRIPLES)
    s, e = (spark.createDataFrame([(1, 1, 1, n), (1, 1, 2, None)], ENT) for n in "ab")
    assert collect(P.enumerate_simple_paths(s, e, t), "entities") == [(("a", "b"),)]
    assert collect(P.bfs_paths_undirected(s, e, t, 1), "entities") == [(("a", "b"),)]
    for args in ((s.limit(0), e, t), (s, e.limit(0), t), (s, e, t.limit(0))):
        assert P.enumerate_simple_paths(*args).isEmpty() and P.bfs_paths_undirected(*args).isEmpty()


@pytest.mark.parametrize("enough, hops", [(None, 4), (3, 4), (None, 1), (None, 3)])
def test_undirected_search_keeps_queue_order(world, enough, hops):
    graphs, triples, starts, targets = world
    want = []
    for g, edges in graphs.items():
        goal, found, paths = {"n2", "n3"}, set(), []
        for s in ("n0", "n1"):
            queue, seen = deque([([s], [])]), {(s, 0)}
            while queue and (enough is None or len(found) < len(goal) or len(paths) < enough):
                nodes, rels = queue.popleft()
                if nodes[-1] in goal and rels:
                    found.add(nodes[-1])
                    paths.append((g, tuple(nodes), tuple(r for r, _ in rels), tuple(d for _, d in rels)))
                if len(rels) < hops:
                    steps = [(r, o, True) for a, r, o in edges if a == nodes[-1]] + [(r, a, False) for a, r, o in edges if o == nodes[-1]]
                    for r, n, d in steps:
                        if (n, len(rels) + 1) not in seen:
                            seen.add((n, len(rels) + 1))
                            queue.append((nodes + [n], rels + [(r, d)]))
        want += paths
    got = P.bfs_paths_undirected(starts, targets, triples, hops, enough)
    assert collect(got, "qid", "entities", "relations", "forward") == sorted(want)


@pytest.mark.parametrize("max_hops", [None, 6])
def test_all_shortest_paths(world, max_hops):
    graphs, triples, starts, targets = world
    want = set()
    for g, edges in graphs.items():
        nodes = {e[0] for e in edges} | {e[2] for e in edges}
        rel = {}
        for s, r, o in edges:
            rel.setdefault((s, o), r)
        for s in {"n0", "n1"} & nodes:
            for t in {"n2", "n3"} & nodes:
                layer, seen, hits = [[s]], {s}, []
                while layer and not hits:
                    hits = [p for p in layer if p[-1] == t]
                    nxt = [p + [o] for p in layer for (a, o) in rel if a == p[-1] and o not in seen]
                    seen |= {p[-1] for p in nxt}
                    layer = nxt
                for p in hits:
                    want.add((g, tuple(p), tuple(rel[a, b] for a, b in zip(p, p[1:]))))
    assert collect(P.all_shortest_paths(starts, targets, triples, max_hops), "qid", "entities", "relations") == sorted(want)


def test_start_that_is_target_has_no_hops(spark):
    t = spark.createDataFrame([(1, "a", "r", "b", 0)], TRIPLES)
    e = spark.createDataFrame([(1, 1, 1, "a")], ENT)
    assert collect(P.all_shortest_paths(e, e, t), "entities", "relations") == [(("a",), ())]


def test_connecting_paths_enter_a_state_once_and_stop_at_hits(spark):
    t = spark.createDataFrame([(1, "a", "r", "b", 0), (1, "a", "r", "c", 1), (1, "b", "s", "d", 2), (1, "c", "s", "d", 3), (1, "d", "r", "d", 4)], TRIPLES)
    pairs = spark.createDataFrame([(1, 1, "A", "d")], "qid bigint, gid bigint, start string, end string")
    assert collect(P.connecting_paths(pairs, t), "entities", "path_string") == [(("a", "b", "d"), "r -> s")]


def test_connecting_paths_keep_the_pairs_of_a_question_apart(spark):
    t = spark.createDataFrame([(1, "a", "r", "x", 0), (1, "a", "r", "y", 1), (1, "b", "r", "y", 2), (1, "b", "r", "x", 3), (1, "b", "s", "y", 4), (1, "y", "s", "x", 5)], TRIPLES)
    pairs = spark.createDataFrame([(1, 1, "A", "X"), (1, 1, "b", "y"), (1, 1, "b", "y")], "qid bigint, gid bigint, start string, end string")
    got = collect(P.connecting_paths(pairs, t), "start", "end", "no", "entities", "path_string")
    assert got == [("A", "X", 1, ("a", "x"), "r"), ("A", "X", 2, ("a", "y", "x"), "r -> s"), ("b", "y", 1, ("b", "y"), "r"), ("b", "y", 2, ("b", "y"), "s")]
    assert collect(P.connecting_paths(pairs, t, max_paths=1), "start", "no") == [("A", 1), ("b", 1)]


def test_follow_path_is_a_set_and_is_cut_in_text_order(spark):
    t = spark.createDataFrame([(1, "A", "r", f"x{i % 5}", i) for i in range(9)] + [(1, f"x{i}", "s", "end", 20 + i) for i in range(5)], TRIPLES)
    start = spark.createDataFrame([(7, 1, "a")], "qid bigint, gid bigint, entity string")
    paths = spark.createDataFrame([(7, 1, ["r"]), (7, 2, ["r", "s"]), (7, 3, ["s"])], "qid bigint, path_id int, relations array<string>")
    got = collect(T.follow_path(start, paths, t, 2, max_results=3), "path_id", "entity")
    assert got == [(1, "x0"), (1, "x1"), (1, "x2"), (2, "end")]


def test_what_several_questions_ask_of_a_node_is_followed_once(spark):
    """Two questions share a node, paths share ends, a path leads round a loop, a hop is missing; few shuffles of the questions' rows."""
    edges = [("a", "r", "x"), ("b", "r", "x"), ("a", "r", "y"), ("x", "s", "e"), ("y", "s", "e"), ("x", "s", "f"), ("e", "t", "a"), ("f", "t", "b")]
    t = spark.createDataFrame([(1, a, r, b, i) for i, (a, r, b) in enumerate(edges)], TRIPLES)
    start = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (2, 1, "b"), (3, 2, "a")], "qid bigint, gid bigint, entity string")
    chains = {1: ["r"], 2: ["r", "s"], 3: ["r", "s", "t"], 4: ["r", "s", "t", "r"], 5: ["r", "t"], 6: ["s"]}
    paths = spark.createDataFrame([(q, k, c) for q in (1, 2, 3) for k, c in chains.items()], "qid bigint, path_id int, relations array<string>")
    whole = {(q, a, k) + (walk,) for q, a in ((1, "a"), (2, "b")) for k, c in chains.items() for walk in walks_of(edges, a, c)}
    rows = T.follow_path(start, paths, t, resolve=False)
    assert collect(rows, "qid", "path_id", "entity") == sorted({(q, k, walk[-1]) for q, _, k, walk in whole})
    text = lambda walk, c: walk[0] + "".join(f" --{r}--> {n}" for r, n in zip(c, walk[1:]))
    ranked = paths.select("qid", F.array_join("relations", " -> ").alias("path"))
    assert collect(T.instantiate_paths(start, ranked, t), "qid", "text") == sorted({(q, text(walk, chains[k])) for q, _, k, walk in whole})
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = T.follow_path(start, paths, t, 3, resolve=False)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("Exchange hashpartitioning") <= 3


def walks_of(edges, at, chain):
    if not chain:
        return [(at,)]
    return [(at, *more) for a, r, b in edges if (a, r) == (at, chain[0]) for more in walks_of(edges, b, chain[1:])]


def test_flexible_following_keeps_repeats_and_drops_machine_ids(spark):
    t = spark.createDataFrame([(1, "a", "place.city.birth_year", "b", 0), (1, "a", "x.place_of_birth", "b", 1), (1, "a", "x.place_of_birth", "m.1", 2), (1, "a", "z", "c", 3)], TRIPLES)
    topic = spark.createDataFrame([(1, 1, "a")], "qid bigint, gid bigint, entity string")
    ranked = spark.createDataFrame([(1, 1, "person.date_of_birth")], "qid bigint, rank int, path string")
    assert collect(T.follow_path_flexible(topic, ranked, t, 1), "entity", "trail") == [("b", (0,)), ("b", (1,))]


def test_containment_pairs_equal_brute_force(spark):
    r = random.Random(1)
    text = lambda n: "".join(r.choice("ab") for _ in range(r.randrange(n)))
    outer, inner = [text(24) for _ in range(60)], [text(20) for _ in range(60)]
    o = spark.createDataFrame([(i % 2, x) for i, x in enumerate(outer)], "g int, o string").distinct()
    n = spark.createDataFrame([(i % 2, x) for i, x in enumerate(inner)], "g int, n string").distinct()
    want = sorted({(i % 2, a, b) for i, a in enumerate(outer) for j, b in enumerate(inner) if i % 2 == j % 2 and b in a})
    assert collect(M.containment_pairs(o, n, ["g"], "o", "n"), "g", "o", "n") == want


def test_match_entities_only_falls_back_when_nothing_is_equal(spark):
    t = spark.createDataFrame([(1, "Paris", "r", "Paris Hilton", 0), (1, "paris ", "r", "x", 1)], TRIPLES)
    names = spark.createDataFrame([(1, 1, "PARIS"), (2, 1, "hilton")], "qid bigint, gid bigint, entity string")
    assert collect(M.match_entities(names, t), "qid", "match") == [(1, "Paris"), (1, "paris "), (2, "Paris Hilton")]


def test_fallbacks_stop_after_enough_entities(spark):
    t = spark.createDataFrame([(1, "a", "r", f"e{i}", i) for i in range(5)] + [(1, "a", "s", "late", 9)], TRIPLES)
    q = spark.createDataFrame([(1, 1)], "qid bigint, gid bigint")
    topic = spark.createDataFrame([(1, 1, "a")], "qid bigint, pos int, entity string")
    preds = spark.createDataFrame([(1, 1, "r -> q"), (1, 2, "s")], "qid bigint, rank int, path string")
    run = lambda n: [e for (e,) in collect(T.retrieve_with_fallbacks(q, topic, preds, t, 2, stop_after=n), "entity")]
    assert run(4) == [f"e{i}" for i in range(5)]
    assert run(5) == [f"e{i}" for i in range(5)] + ["late"]


def test_question_without_topic_starts_at_first_subject(spark):
    t = spark.createDataFrame([(1, "b", "r", "x", 0), (1, "a", "r", "y", 1)], TRIPLES)
    q = spark.createDataFrame([(1, 1)], "qid bigint, gid bigint")
    none = spark.createDataFrame([], "qid bigint, pos int, entity string")
    preds = spark.createDataFrame([(1, 1, "r")], "qid bigint, rank int, path string")
    assert collect(T.retrieve_with_fallbacks(q, none, preds, t, 1, stop_after=50), "entity") == [("y",)]
