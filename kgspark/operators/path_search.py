"""Finding paths between entities: level-by-level joins in which the queue order of a search is carried as data.

Every level is written out (``cut_lineage``): it is used twice (as a result and as the base of the next level), and a lost executor must
not send the search back to the first level. A state keeps ``steps``, the list of (direction, triple position) taken so far. Comparing two such lists of equal length
compares their places in a breadth-first queue, so "first arrival" is a plain ``min`` aggregate and needs no numbering.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import beside, cut_lineage
from .adjacency import PAGE_ROWS, Adjacency, incoming, outgoing
from .entity_match import match_entities, resolve_entity
from .numbering import first_per, positions, top_per

_NO_STEPS = "array<struct<dir:int,idx:int>>"


def _reach(targets: DataFrame, edges: DataFrame, levels: int, keys: tuple[str, ...], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``targets(*keys, entity)`` → ``(*keys, node, dist)``: nodes within ``levels`` hops before a target. ``gid`` is one of the keys."""
    seen = targets.select(*keys, F.col("entity").alias("node")).distinct().withColumn("dist", F.lit(0))
    ring = seen
    for level in range(1, levels + 1):
        back = edges.select("gid", F.col("next").alias("node"), F.col("node").alias("prev"))
        ring = ring.select(*keys, "node").join(back, ["gid", "node"]).select(
            *keys, F.col("prev").alias("node")).distinct().withColumn("dist", F.lit(level))
        seen = keep(seen.unionByName(ring).groupBy(*keys, "node").agg(F.min("dist").alias("dist")))
        ring = seen.filter(F.col("dist") == level)
    return seen


def _near(live: DataFrame, reach: DataFrame, left: int, levels: int, keys: tuple[str, ...] = ("qid", "gid")) -> DataFrame:
    """Drop states from which no target lies within the ``left`` remaining hops (where ``reach`` goes that far)."""
    if left > levels:
        return live
    return live.join(reach.filter(F.col("dist") <= left).select(*keys, "node"), [*keys, "node"], "left_semi")


def enumerate_simple_paths(starts: DataFrame, targets: DataFrame, triples: DataFrame, max_depth: int = 3, page_rows: int = PAGE_ROWS,
                           by_graph: bool = False) -> DataFrame:
    """All directed paths without repeated entity, of 1 to ``max_depth`` hops, from any start to any target.

    ``starts``/``targets`` are ``(qid, gid, entity)``. The paths go on through targets. Halves grow from both ends and meet: a path
    longer than the first halves is cut at exactly one node. Which end grows next is chosen by the rows it would make, told
    from the nodes' degrees, so a hub at one end is met from the other. ``by_graph``: the triples are bucketed by gid (see ``Adjacency``).
    """
    out, into = (Adjacency(edges(triples), page_rows, by_graph) for edges in (outgoing, incoming))
    return _simple_paths(starts, targets, out, into, max_depth)


def _simple_paths(starts: DataFrame, targets: DataFrame, out: Adjacency, into: Adjacency, max_depth: int) -> DataFrame:
    ends = [out.place(df.select("qid", "gid", F.col("entity").alias("node"))).distinct() for df in (starts, targets)]
    return _paths_between(ends[0], ends[1], out, into, max_depth)


def _paths_between(starts: DataFrame, targets: DataFrame, out: Adjacency, into: Adjacency, max_depth: int) -> DataFrame:
    """As ``_simple_paths``, from distinct ``(qid, gid, node)`` that lie with their graph where graphs stay whole."""
    ends = [starts, targets]
    both = ends[0].select("qid", "gid").distinct().join(out.near(ends[1].select("qid", "gid").distinct()), ["qid", "gid"], "left_semi")
    first = [out.keep(e.join(out.near(both), ["qid", "gid"], "left_semi").withColumn("entities", F.array("node")).withColumn(
        "relations", F.array().cast("array<string>"))) for e in ends]
    halves, sides, add = [[first[0]], [first[1]]], [out, into], [F.array_append, F.array_prepend]
    cost = [side.rows_after(half) for side, half in zip(sides, first)]
    for _ in range(max_depth):
        i = 0 if cost[0] <= cost[1] else 1
        step = sides[i].step(halves[i][-1]).filter(~F.array_contains("entities", F.col("next"))).select(
            "qid", "gid", F.col("next").alias("node"), add[i]("entities", F.col("next")).alias("entities"), add[i]("relations", F.col("rel")).alias("relations"))
        halves[i].append(out.keep(step))
        cost[i] = sides[i].rows_after(halves[i][-1])
    ahead, back = halves
    own = ["qid", "gid"] if out.by_graph else ["qid"]  # whole graphs: a question has one
    front = ahead[-1].select("qid", "gid", "node", F.col("entities").alias("e"), F.col("relations").alias("r"))
    tail = F.slice("entities", F.lit(2), F.size("entities"))
    met = [front.join(out.near(half), ["qid", "gid", "node"]).filter(~F.arrays_overlap("e", tail)).select(
        *own, F.concat("e", tail).alias("entities"), F.concat("r", "relations").alias("relations")) for half in (back if len(ahead) > 1 else back[1:])]
    short = [half.join(out.near(first[1]), ["qid", "gid", "node"], "left_semi").select(*own, "entities", "relations") for half in ahead[1:-1]]
    # a triple listed twice is one step; every part has its own length of paths
    return reduce(DataFrame.unionByName, [part.distinct() for part in short + met]).drop("gid")


def label_reasoning_paths(names_q: DataFrame, names_a: DataFrame, triples: DataFrame, max_depth: int = 3, by_graph: bool = False) -> DataFrame:
    """Match both ends to the graph, then all simple paths from question to answer, and those found the other way round
    turned and flagged. → ``(qid, direction, entities, relations, path_string, relation_chain, path_length)``"""
    out, into = (Adjacency(edges(triples), by_graph=by_graph) for edges in (outgoing, incoming))
    named = lambda names: out.keep(match_entities(out.place(names), triples, out).select("qid", "gid", F.col("match").alias("node")).distinct())
    q, a = named(names_q), named(names_a)
    ahead = _paths_between(q, a, out, into, max_depth).withColumn("direction", F.lit("forward"))
    back = _paths_between(a, q, out, into, max_depth).select(
        "qid", F.reverse("entities").alias("entities"), F.reverse("relations").alias("relations"),
        F.lit("reversed").alias("direction"))
    e, r = F.col("entities"), F.col("relations")
    return ahead.unionByName(back).select("qid", "direction", "entities", "relations", S.path_string(e, r).alias("path_string"),
                                          S.relation_chain(r).alias("relation_chain"), F.size(r).alias("path_length"))


def bfs_paths_undirected(starts: DataFrame, targets: DataFrame, triples: DataFrame, max_hops: int = 4, enough: int | None = None,
                         page_rows: int = PAGE_ROWS, by_graph: bool = False) -> DataFrame:
    """Paths that use edges in both directions; an (entity, depth) state is entered once per start, by the first arrival.

    ``starts(qid, gid, pos, entity)``, ``targets(qid, gid, entity)`` →
    ``(qid, pos, depth, steps, entities, relations, forward)``. The list of a question ends once it holds ``enough`` paths
    and every target has been seen; ``None`` switches that off.

    The first arrival is the least list of steps, and of lists that pass the same node at the same depth the least has the least list
    up to the node and the least one after it. So half of the hops are made from the starts, half from the targets (once for all
    questions that share a target of a graph), each half keeping one row per node and depth, and the halves meet.
    """
    side = lambda a, b, direction: F.struct(F.col(a).alias("node"), F.col(b).alias("next"), F.lit(direction).alias("dir"))
    both = triples.select("gid", "rel", "triple_idx", F.explode(F.array(side("subj", "obj", 0), side("obj", "subj", 1))).alias("_s"))
    edges = Adjacency(both.select("gid", "_s.node", "rel", "_s.next", "triple_idx", "_s.dir"), page_rows, by_graph)
    goal = edges.keep(edges.place(targets.select("qid", "gid", F.col("entity").alias("target"))).distinct())
    at = lambda direction: F.struct(direction.alias("dir"), F.col("triple_idx").cast("int").alias("idx"))
    begin = [F.array().cast(_NO_STEPS).alias("steps"), F.array("node").alias("entities"), F.array().cast("array<string>").alias("relations")]
    # a repeated start brings nothing new; questions without targets have nothing to find
    asked = ["qid", "gid"] if edges.by_graph else ["qid"]
    live = first_per(edges.place(starts.select("qid", "gid", "pos", "entity")), ["qid", "gid", "entity"], ["pos"]).join(
        goal.select(*asked).distinct(), asked, "left_semi").select("qid", "gid", "pos", F.col("entity").alias("node")).select("*", *begin)
    ahead = []
    for _ in range((max_hops + 1) // 2):
        step = edges.step(live).select(
            "qid", "gid", "pos", F.col("next").alias("node"), F.array_append("steps", at(F.col("dir"))).alias("steps"),
            F.array_append("entities", F.col("next")).alias("entities"), F.array_append("relations", F.col("rel")).alias("relations"))
        live = edges.keep(first_per(step, ["qid", "gid", "pos", "node"], ["steps"]))
        ahead.append(live)
    live = goal.select("gid", "target", F.col("target").alias("node")).distinct().select("*", *begin)
    back = []
    for _ in range(max_hops // 2):
        step = edges.step(live).select(  # an edge seen from its far end is walked the other way
            "gid", "target", F.col("next").alias("node"), F.array_prepend("steps", at(1 - F.col("dir"))).alias("steps"),
            F.array_prepend("entities", F.col("next")).alias("entities"), F.array_prepend("relations", F.col("rel")).alias("relations"))
        live = edges.keep(first_per(step, ["gid", "target", "node"], ["steps"]))
        back.append(live)
    kept = ["qid", "pos", "depth", "steps", "entities", "relations"]
    near = goal.withColumnRenamed("target", "node")
    found = reduce(DataFrame.unionByName, [half.join(edges.near(near), ["qid", "gid", "node"], "left_semi").withColumn("depth", F.lit(d)).select(*kept) for d, half in enumerate(ahead, 1)])
    if back:
        front = ahead[-1].select("qid", "gid", "pos", "node", F.col("steps").alias("s"), F.col("entities").alias("e"), F.col("relations").alias("r")).join(edges.near(goal), ["qid", "gid"])
        for d, half in enumerate(back, len(ahead) + 1):  # a depth at a time, so that halves meet where they lie
            met = front.join(edges.near(half), ["gid", "target", "node"]).select(
                "qid", "gid", "pos", "target", F.lit(d).alias("depth"), F.concat("s", "steps").alias("steps"),
                F.concat("e", F.slice("entities", F.lit(2), F.size("entities"))).alias("entities"), F.concat("r", "relations").alias("relations"))
            found = found.unionByName(first_per(met, ["qid", "gid", "pos", "target", "depth"], ["steps"]).select(*kept))
    if enough is not None:
        found = _stop_when_complete(cut_lineage(found), near, enough)
    return found.withColumn("forward", F.transform("steps", lambda s: s["dir"] == 0))


def _stop_when_complete(found: DataFrame, goal: DataFrame, enough: int) -> DataFrame:
    """Cut each question's list after ``enough`` paths, but not before its last target has appeared."""
    target = F.element_at("entities", -1)
    sizes = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(target).alias("hit"))
    wanted = goal.groupBy("qid").agg(F.count(F.lit(1)).alias("wanted"))
    long = cut_lineage(sizes.join(wanted, "qid").filter((F.col("n") > enough) & (F.col("hit") == F.col("wanted"))).select("qid"))
    if long.isEmpty():
        return found
    rows = positions(found.join(long, "qid", "left_semi"), ["pos", "depth", "steps"], ["qid"], "_at", 1)
    last_new = rows.groupBy("qid", target.alias("t")).agg(F.min("_at").alias("at")).groupBy("qid").agg(
        F.greatest(F.max("at"), F.lit(enough)).alias("last"))
    cut = rows.join(last_new, "qid").filter(F.col("_at") <= F.col("last")).select(*found.columns)
    return found.join(long, "qid", "left_anti").unionByName(cut)


def select_paths(paths: DataFrame, order: list[str], per_target: int | None = None, total: int | None = None) -> DataFrame:
    """Shortest paths first, ``per_target`` per last entity, no repeated text, ``total`` per question; all without them.

    ``order`` names the columns that settle ties between paths of one length; both limits run before the shuffle too.
    """
    rows = paths.withColumn("_hops", F.size("relations")).withColumn("_target", F.element_at("entities", -1)).withColumn(
        "full_path", S.full_path(F.col("entities"), F.col("relations"), F.col("forward") if "forward" in paths.columns else None))
    kept = top_per(rows, ["qid", "_target"], ["_hops", *order], per_target, "_k")
    once = first_per(kept, ["qid", "full_path"], ["_hops", *order])
    return top_per(once, ["qid"], ["_hops", *order], total, "path_no").drop("_hops", "_target", "_k")


def connecting_paths(pairs: DataFrame, triples: DataFrame, max_depth: int = 3, max_paths: int | None = None, resolve: bool = True,
                     by_graph: bool = False) -> DataFrame:
    """``pairs(qid, gid, start, end)`` → ``(qid, start, end, no, entities, relations, path_string)``, shortest first, at most
    ``max_paths`` of every pair. An entity is entered once per relation sequence; the search does not go beyond a hit.

    Pairs are searched apart, so two pairs of a question never give a path from one's start to the other's end. What lies within
    reach of an end is worked out once per graph and end, however many pairs ask for it.
    """
    edges = Adjacency(outgoing(triples, "triple_idx"), by_graph=by_graph)
    pairs = edges.place(pairs.select("qid", "gid", "start", "end")).distinct()
    if resolve:
        named = lambda c: resolve_entity(pairs.select("qid", "gid", F.col(c).alias("entity")), triples).select("qid", "gid", F.col("entity").alias(c), "match")
        s = pairs.join(named("start"), ["qid", "gid", "start"]).withColumnRenamed("match", "node")
        t = edges.keep(named("end").select("gid", "end", F.col("match").alias("entity")).distinct())
    else:
        s = pairs.withColumn("node", F.col("start"))
        t = pairs.select("gid", "end", F.col("end").alias("entity")).distinct()
    own, ends, levels = ["qid", "gid", "start", "end"], ("gid", "end"), max_depth - 1
    reach = _reach(t, outgoing(triples), levels, ends, edges.keep)
    goal = t.select("gid", "end", F.col("entity").alias("node"))
    live = edges.keep(s.distinct()).withColumn("entities", F.array("node")).withColumn("relations", F.array().cast("array<string>")).withColumn(
        "steps", F.array().cast("array<int>"))
    found = None
    for depth in range(1, max_depth + 1):
        step = edges.step(live).select(
            *own, F.col("next").alias("node"), F.array_append("entities", F.col("next")).alias("entities"),
            F.array_append("relations", F.col("rel")).alias("relations"),
            F.array_append("steps", F.col("triple_idx").cast("int")).alias("steps"))
        step = _near(step, edges.near(reach), max_depth - depth, levels, ends)
        fresh = edges.keep(first_per(step, [*own, "node", "relations"], ["steps", "entities"]))
        hit = fresh.join(edges.near(goal), [*ends, "node"], "left_semi")
        found = hit if found is None else found.unionByName(hit)
        live = fresh.join(edges.near(goal), [*ends, "node"], "left_anti")
    best = top_per(found, own, [F.size("relations"), F.col("steps"), F.col("entities")], max_paths, "no")
    return best.select("qid", "start", "end", "no", "entities", "relations", S.relation_chain(F.col("relations")).alias("path_string"))


def all_shortest_paths(starts: DataFrame, targets: DataFrame, triples: DataFrame, max_hops: int | None = None, by_graph: bool = False) -> DataFrame:
    """Every shortest directed path per (start, target) present in the graph → ``(qid, entities, relations, relation_chain)``.

    Between two entities the first triple in the list gives the relation. A start that is a target gives a path without
    hops. Distances grow outwards from the starts; paths are then traced back from the targets, so only rows on a
    shortest path carry arrays. Without ``max_hops`` the search runs until nothing new is reached, and each level is
    checkpointed.
    """
    edges = first_per(triples.select("gid", "subj", "obj", "rel", "triple_idx"), ["gid", "subj", "obj"], ["triple_idx"]).select(
        "gid", F.col("subj").alias("node"), F.col("obj").alias("next"), "rel")
    ways = Adjacency(edges, by_graph=by_graph)
    nodes = triples.select("gid", F.explode(F.array("subj", "obj")).alias("entity")).distinct()
    present = lambda df: ways.place(df.select("qid", "gid", "entity")).distinct().join(ways.near(nodes), ["gid", "entity"], "left_semi")
    s, t = present(starts), present(targets)
    keys = ["qid", "gid", "source", "node"]
    asked = ["qid", "gid"] if ways.by_graph else ["qid"]
    ring = s.select("qid", "gid", F.col("entity").alias("source"), F.col("entity").alias("node")).join(
        t.select(*asked).distinct(), asked, "left_semi")
    ring = ways.keep(ring)
    rings, seen = [ring], [ring]
    while max_hops is None or len(rings) <= max_hops:
        ring = ways.step(ring).select("qid", "gid", "source", F.col("next").alias("node")).distinct()
        for known in seen if ways.by_graph else [reduce(DataFrame.unionByName, seen)]:  # a union would not lie by graph
            ring = ring.join(ways.near(known), keys, "left_anti")
        ring = ways.keep(ring)
        if max_hops is None and ring.isEmpty():
            break
        rings.append(ring)
        seen.append(ring)
        if ways.by_graph and len(seen) == 4:  # so that a level of a long search has few joins
            seen = [ways.keep(reduce(DataFrame.unionByName, seen))]
    goal = ways.keep(t.select("qid", "gid", F.col("entity").alias("node")))
    into = ways.pages.select("gid", F.col("next").alias("node"), F.col("node").alias("prev"), "rel")
    moved, parts = None, []
    for d in range(len(rings) - 1, -1, -1):
        hit = rings[d].join(ways.near(goal), ["qid", "gid", "node"], "left_semi").select(
            *keys, F.array("node").alias("entities"), F.array().cast("array<string>").alias("relations"))
        if d == 0:
            parts.append(hit)
            continue
        before = [at.join(ways.near(into), ["gid", "node"]).select(
            "qid", "gid", "source", F.col("prev").alias("node"), F.array_prepend("entities", F.col("prev")).alias("entities"),
            F.array_prepend("relations", F.col("rel")).alias("relations")).join(ways.near(rings[d - 1]), keys, "left_semi")
            for at in ([hit] if moved is None else [hit, moved])]
        moved = ways.keep(reduce(DataFrame.unionByName, before))
    if moved is not None:
        parts.append(moved)
    found = [part.select(*asked, "entities", "relations").distinct() for part in parts]
    return reduce(DataFrame.unionByName, found).drop("gid").withColumn("relation_chain", S.relation_chain(F.col("relations")))


def path_triples(paths: DataFrame, triples: DataFrame) -> DataFrame:
    """``paths(qid, gid, path_no, entities, relations)`` → the first triple of every step, where the graph has it."""
    steps = paths.select("qid", "gid", "path_no", F.posexplode(F.transform("relations", lambda r, i: F.struct(
        F.get("entities", i).alias("subj"), r.alias("rel"), F.get("entities", i + 1).alias("obj")))).alias("step", "t")).select(
        "qid", "gid", "path_no", "step", "t.*")
    first = triples.groupBy("gid", "subj", "rel", "obj").agg(F.min("triple_idx").alias("triple_idx"))
    return steps.join(beside(first), ["gid", "subj", "rel", "obj"]).select("qid", "gid", "path_no", "step", "subj", "rel", "obj", "triple_idx")
