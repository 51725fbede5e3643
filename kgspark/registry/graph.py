"""Queries over triples: filters, traversal, path search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import entity_match as M
from ..operators import path_search as P
from ..operators import traversal as T
from ..plans import canonical as K
from .core import query, with_tables

text = lambda c: F.array_join(c, "|")
chain_table = lambda: [F.split(F.lit(" -> ".join(c)), " -> ") for c in K.CHAINS]


def own_ends(spark, d):
    q = K.q_entities(spark, d).withColumn("gid", F.col("qid"))
    a = K.a_entities(spark, d).withColumn("gid", F.col("qid"))
    return q, a


def all_chains(spark, d):
    """Every relation chain for every question."""
    return K.ranked(spark, d).select("qid", "path_id", F.split("path", " -> ").alias("relations"))


@query("neighbors_both", with_tables("triples", body="""select distinct rel, 'forward' direction, obj neighbor from triples where subj = 'NATION_3'
union select distinct rel, 'backward', subj from triples where obj = 'NATION_3'"""))
def _(spark, d):
    return T.neighbors(K.triples(spark, d), "NATION_3", "both")


@query("neighbors_filtered", with_tables("triples", body="""select distinct rel, 'backward' direction, subj neighbor from triples
where obj = 'NATION_3' and rel in ('supplier.supplier.nation')"""))
def _(spark, d):
    return T.neighbors(K.triples(spark, d), "NATION_3", "backward", [K.SUPPLIER_NATION])


@query("entities_for_relation", with_tables("triples", body="select distinct obj entity from triples where rel = 'part.part.brand'"))
def _(spark, d):
    return T.entities_for_relation(K.triples(spark, d), K.PART_BRAND)


@query("traverse_relation", with_tables("triples", "q_entities", body="""select distinct q.qid, t.gid, t.obj entity from q_entities q
join triples t on t.subj = q.entity and t.rel = 'order.order.supplier'"""))
def _(spark, d):
    starts = K.q_entities(spark, d).withColumn("gid", F.lit(0).cast("bigint"))
    return T.traverse_relation(starts, K.triples(spark, d), K.TO_SUPPLIER)


_FOLLOWED = """h1 as (select distinct q.qid, c.path_id, c.path, t.obj e from q_entities q join triples t on t.subj = q.entity
    join chains c on string_split(c.path, ' -> ')[1] = t.rel),
  h2 as (select distinct h.qid, h.path_id, h.path, t.obj e from h1 h join triples t on t.subj = h.e and t.rel = string_split(h.path, ' -> ')[2]),
  h3 as (select distinct h.qid, h.path_id, h.path, t.obj e from h2 h join triples t on t.subj = h.e and t.rel = string_split(h.path, ' -> ')[3]),
  followed as (select qid, path_id, e from h1 where len(string_split(path, ' -> ')) = 1 union all
    select qid, path_id, e from h2 where len(string_split(path, ' -> ')) = 2 union all
    select qid, path_id, e from h3 where len(string_split(path, ' -> ')) = 3)"""


def _with_followed(*names, body):
    return with_tables("triples", "q_entities", "chains", *names, body="@").replace(") @", f"), {_FOLLOWED} {body}")


@query("follow_path", _with_followed(body="select qid, cast(path_id as bigint) path_id, e entity from followed"))
def _(spark, d):
    starts = K.q_entities(spark, d).withColumn("gid", F.lit(0).cast("bigint"))
    return T.follow_path(starts, all_chains(spark, d), K.triples(spark, d), 3).select("qid", "path_id", "entity")


@query("follow_path_capped", _with_followed(body="""select qid, cast(path_id as bigint) path_id, e entity from (
  select *, row_number() over (partition by qid, path_id order by e) k from followed) x where k <= 2"""))
def _(spark, d):
    starts = K.q_entities(spark, d).withColumn("gid", F.lit(0).cast("bigint"))
    return T.follow_path(starts, all_chains(spark, d), K.triples(spark, d), 3, max_results=2, resolve=False).select("qid", "path_id", "entity")


@query("follow_path_backward", with_tables("triples", body="""select 'S' || s_suppkey as start, t2.subj entity from supplier
join triples t on t.obj = 'S' || s_suppkey and t.rel = 'order.order.supplier' join triples t2 on t2.subj = t.subj and t2.rel = 'order.order.supplier' and t2.obj = t.obj
group by 1, 2"""))
def _(spark, d):
    s = K.table(spark, d, "supplier").select(F.col("s_suppkey").alias("qid"), F.lit(0).cast("bigint").alias("gid"),
                                             F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("entity"))
    p = s.select("qid", F.lit(0).alias("path_id"), F.array(F.lit(K.TO_SUPPLIER)).alias("relations"))
    return T.follow_path(s, p, K.triples(spark, d), 1, "backward", None, resolve=False).select("start", "entity")


@query("follow_bidirectional", with_tables("triples", body="""select qid, start, entity, side, k as rank from (
  select *, row_number() over (partition by qid order by side, entity) k from (
    select qid, start, entity, min(side) side from (
      select s_suppkey qid, 'S' || s_suppkey as start, t2.obj entity, 0 side from supplier join triples t1 on t1.subj = 'S' || s_suppkey and t1.rel = 'supplier.supplier.nation'
        join triples t2 on t2.subj = t1.obj and t2.rel = 'nation.nation.region'
      union select s_suppkey, 'S' || s_suppkey, t2.subj, 1 from supplier join triples t1 on t1.obj = 'S' || s_suppkey and t1.rel = 'nation.nation.region'
        join triples t2 on t2.obj = t1.subj and t2.rel = 'supplier.supplier.nation') x group by qid, start, entity) y) z where k <= 100"""))
def _(spark, d):
    s = K.table(spark, d, "supplier").select(F.col("s_suppkey").alias("qid"), F.lit(0).cast("bigint").alias("gid"),
                                             F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("entity"))
    p = s.select("qid", F.lit(0).alias("path_id"), F.array(F.lit(K.SUPPLIER_NATION), F.lit(K.NATION_REGION)).alias("relations"))
    return T.follow_bidirectional(s, p, K.triples(spark, d), 2).select(
        "qid", "start", "entity", "side", F.col("rank").cast("bigint").alias("rank"))


@query("follow_path_flexible", with_tables("triples", "q_entities", "ranked", body="""select h.qid, cast(h.rank as bigint) as rank, h.e entity, count(*) copies from (
  select r.qid, r.rank, t.obj e from ranked r join q_entities q using (qid) join triples t on t.subj = q.entity
    join m on m.a = string_split(r.path, ' -> ')[1] and m.b = t.rel where len(string_split(r.path, ' -> ')) = 1
  union all select r.qid, r.rank, t2.obj from ranked r join q_entities q using (qid) join triples t on t.subj = q.entity
    join m on m.a = string_split(r.path, ' -> ')[1] and m.b = t.rel join triples t2 on t2.subj = t.obj
    join m m2 on m2.a = string_split(r.path, ' -> ')[2] and m2.b = t2.rel where len(string_split(r.path, ' -> ')) = 2
  union all select r.qid, r.rank, t3.obj from ranked r join q_entities q using (qid) join triples t on t.subj = q.entity
    join m on m.a = string_split(r.path, ' -> ')[1] and m.b = t.rel join triples t2 on t2.subj = t.obj
    join m m2 on m2.a = string_split(r.path, ' -> ')[2] and m2.b = t2.rel join triples t3 on t3.subj = t2.obj
    join m m3 on m3.a = string_split(r.path, ' -> ')[3] and m3.b = t3.rel where len(string_split(r.path, ' -> ')) = 3) h
where not starts_with(h.e, 'm.') and not starts_with(h.e, 'g.') group by 1, 2, 3""",
    m="""select distinct a.rel a, b.rel b from (select distinct rel from triples) a join (select distinct rel from triples) b
    on contains(a.rel, b.rel) or contains(b.rel, a.rel) or string_split(a.rel, '.')[-1] = string_split(b.rel, '.')[-1]"""))
def _(spark, d):
    topics = K.q_entities(spark, d).withColumn("gid", F.lit(0).cast("bigint"))
    rows = T.follow_path_flexible(topics, K.ranked(spark, d), K.triples(spark, d), 3)
    return rows.groupBy("qid", F.col("rank").cast("bigint").alias("rank"), "entity").agg(F.count(F.lit(1)).alias("copies"))


@query("relation_match_pairs", """with rels as (select distinct word as r from (select unnest(list_filter(regexp_split_to_array(lower(replace(text, ',', '.')), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+'), lambda w: w <> '')) word from benchmark) x where word like '%.%'),
kw as (select unnest(['language', 'birthplace', 'birth', 'death', 'religion', 'country', 'capital', 'president', 'founder', 'location',
  'spouse', 'parent', 'child', 'team', 'school', 'university']) k)
select a.r path_rel, b.r graph_rel from rels a join rels b on contains(a.r, b.r) or contains(b.r, a.r)
  or string_split(a.r, '.')[-1] = string_split(b.r, '.')[-1]
  or exists (select 1 from kw where contains(string_split(a.r, '.')[-1], k) and contains(string_split(b.r, '.')[-1], k))""")
def _(spark, d):
    w = S.words(F.lower(F.replace("text", F.lit(","), F.lit("."))))
    rels = K.table(spark, d, "benchmark").select(F.explode(w).alias("r")).filter(F.contains("r", F.lit("."))).distinct()
    return T.relation_match_pairs(rels.select(F.col("r").alias("path_rel")), rels.select(F.col("r").alias("graph_rel")))


@query("instantiate_paths", with_tables("triples", "q_entities", "ranked", body="""select distinct qid, x as text from (
  select r.qid, q.entity || ' --' || t1.rel || '--> ' || t1.obj x from ranked r join q_entities q using (qid)
    join triples t1 on t1.subj = q.entity and t1.rel = string_split(r.path, ' -> ')[1] where len(string_split(r.path, ' -> ')) = 1
  union all select r.qid, q.entity || ' --' || t1.rel || '--> ' || t1.obj || ' --' || t2.rel || '--> ' || t2.obj from ranked r join q_entities q using (qid)
    join triples t1 on t1.subj = q.entity and t1.rel = string_split(r.path, ' -> ')[1] join triples t2 on t2.subj = t1.obj and t2.rel = string_split(r.path, ' -> ')[2]
    where len(string_split(r.path, ' -> ')) = 2
  union all select r.qid, q.entity || ' --' || t1.rel || '--> ' || t1.obj || ' --' || t2.rel || '--> ' || t2.obj || ' --' || t3.rel || '--> ' || t3.obj
    from ranked r join q_entities q using (qid)
    join triples t1 on t1.subj = q.entity and t1.rel = string_split(r.path, ' -> ')[1] join triples t2 on t2.subj = t1.obj and t2.rel = string_split(r.path, ' -> ')[2]
    join triples t3 on t3.subj = t2.obj and t3.rel = string_split(r.path, ' -> ')[3] where len(string_split(r.path, ' -> ')) = 3) y"""))
def _(spark, d):
    starts = K.q_entities(spark, d).withColumn("gid", F.lit(0).cast("bigint"))
    return T.instantiate_paths(starts, K.ranked(spark, d), K.triples(spark, d), 3)


@query("retrieve_with_fallbacks", _with_followed("ranked", body=""", v as (select distinct x.qid, x.rank, y.variant from
  (select qid, rank, string_split(path, ' -> ') r from ranked where rank <= 3) x,
  lateral (select unnest(list_concat([array_to_string(list_slice(r, 1, 1), ' -> '), array_to_string(list_slice(r, 1, 2), ' -> '), array_to_string(r, ' -> ')], r,
    case when len(r) >= 2 then [r[1] || ' -> ' || r[-1]] else [] end)) variant) y),
  f as (select distinct v.qid, v.rank, g.e from v join chains c on c.path = v.variant join followed g on g.qid = v.qid and g.path_id = c.path_id),
  firsts as (select qid, e, min(rank) at_rank from f group by qid, e),
  opened as (select qid, at_rank, coalesce(sum(n) over (partition by qid order by at_rank rows between unbounded preceding and 1 preceding), 0) b
    from (select qid, at_rank, count(*) n from firsts group by qid, at_rank) x)
  select qid, e entity from firsts join opened using (qid, at_rank) where b <= 3"""))
def _(spark, d):
    q = K.questions(spark, d)
    preds = K.ranked(spark, d).filter("rank <= 3")
    return T.retrieve_with_fallbacks(q, K.q_entities(spark, d), preds, K.triples(spark, d), 3, stop_after=3, resolve=False)


@query("one_hop_keyword_fallback", with_tables("triples", "q_entities", "questions", body="""select qid, cast(k as bigint) pos, entity from (
  select x.qid, t.obj entity, row_number() over (partition by x.qid order by t.triple_idx) k
  from (select n.n_nationkey qid, 'which ' || 'team is from ' || n_name question, n_name topic from nation n) x
  join (select subj, replace(replace(rel, 'nation.nation.region', 'place.birth.region'), 'x', 'x') rel, obj, triple_idx from triples) t on t.subj = x.topic and contains(lower(t.rel), 'birth')) y where k <= 20"""))
def _(spark, d):
    n = K.table(spark, d, "nation")
    q = n.select(F.col("n_nationkey").alias("qid"), F.lit(0).cast("bigint").alias("gid"),
                 F.concat(F.lit("which team is from "), F.col("n_name")).alias("question"))
    topics = n.select(F.col("n_nationkey").alias("qid"), F.col("n_name").alias("entity"))
    triples = K.triples(spark, d).withColumn("rel", F.replace("rel", F.lit("nation.nation.region"), F.lit("place.birth.region")))
    none = topics.select("qid", F.lit(1).alias("pos"), "entity").filter(F.lit(False))
    return T.one_hop_keyword_fallback(q, topics, none, triples)


@query("match_entities", with_tables("triples", body="""select n_nationkey qid, name entity, m as match from (
    select n_nationkey, case when n_nationkey < 10 then '  ' || lower(n_name) else substr(n_name, 3, 20) end as name from nation) n
  join lateral (select e as m from (select subj e from triples union select obj from triples) g
    where case when exists (select 1 from (select subj e2 from triples union select obj from triples) h where lower(trim(e2)) = lower(trim(n.name)))
      then lower(trim(e)) = lower(trim(n.name)) else contains(lower(trim(e)), lower(trim(n.name))) or contains(lower(trim(n.name)), lower(trim(e))) end) on true"""))
def _(spark, d):
    key = F.col("n_nationkey")
    name = F.when(key < 10, F.concat(F.lit("  "), F.lower("n_name"))).otherwise(F.substring("n_name", 3, 20))
    names = K.table(spark, d, "nation").select(key.alias("qid"), F.lit(0).cast("bigint").alias("gid"), name.alias("entity"))
    return M.match_entities(names, K.triples(spark, d)).select("qid", "entity", "match")


@query("resolve_entity", with_tables("triples", body="""select o_orderkey qid, lower('O' || o_orderkey) entity, e as match from orders
  join (select subj e from triples union select obj from triples) g on lower(e) = lower('O' || o_orderkey)"""))
def _(spark, d):
    names = K.q_entities(spark, d).select("qid", F.lit(0).cast("bigint").alias("gid"), F.lower("entity").alias("entity"))
    return M.resolve_entity(names, K.triples(spark, d)).select("qid", "entity", "match")


_THREE = """found as (select g.gid qid, [g.subj, g.obj] ents, [g.rel] rels from subgraphs g join a_entities a on a.qid = g.gid and a.entity = g.obj where g.subj = 'O' || g.gid
  union select g.gid, [g.subj, g.obj, h.obj], [g.rel, h.rel] from subgraphs g join subgraphs h on g.gid = h.gid and g.obj = h.subj join a_entities a on a.qid = g.gid and a.entity = h.obj
    where g.subj = 'O' || g.gid
  union select g.gid, [g.subj, g.obj, h.obj, i.obj], [g.rel, h.rel, i.rel] from subgraphs g join subgraphs h on g.gid = h.gid and g.obj = h.subj
    join subgraphs i on i.gid = h.gid and i.subj = h.obj join a_entities a on a.qid = g.gid and a.entity = i.obj where g.subj = 'O' || g.gid)"""


def _with_three(body):
    return with_tables("subgraphs", "a_entities", body="@").replace(") @", f"), {_THREE} {body}")


@query("enumerate_simple_paths", _with_three("select qid, array_to_string(ents, '|') entities, array_to_string(rels, '|') relations from found"))
def _(spark, d):
    q, a = own_ends(spark, d)
    return P.enumerate_simple_paths(q, a, K.subgraphs(spark, d), 3, by_graph=True).select(
        "qid", text("entities").alias("entities"), text("relations").alias("relations"))


@query("shared_graph_paths", _with_three("select qid, array_to_string(ents, '|') entities, array_to_string(rels, '|') relations from found"))
def _(spark, d):
    """As above, with all questions in one graph, in which nations and regions are hubs. What an order reaches is the same."""
    q, a = (e.withColumn("gid", F.lit(0).cast("bigint")) for e in own_ends(spark, d))
    return P.enumerate_simple_paths(q, a, K.triples(spark, d), 3, page_rows=1000).select(
        "qid", text("entities").alias("entities"), text("relations").alias("relations"))


@query("label_reasoning_paths", _with_three("""select qid, 'forward' direction, '(' || ents[1] || ') --[' || rels[1] || ']--> (' || ents[2] || ') | (' || ents[2] || ') --[' || rels[2] || ']--> (' || ents[3]
  || ') | (' || ents[3] || ') --[' || rels[3] || ']--> (' || ents[4] || ')' path_string, array_to_string(rels, ' -> ') relation_chain, cast(len(rels) as integer) path_length from found"""))
def _(spark, d):
    q, a = own_ends(spark, d)
    return P.label_reasoning_paths(q, a, K.subgraphs(spark, d), 3, by_graph=True).drop("entities", "relations")


_BFS = """e as (select gid, subj n, rel, obj m, 0 dir, triple_idx from subgraphs union all select gid, obj, rel, subj, 1, triple_idx from subgraphs),
  s0 as (select o_orderkey gid, 'O' || o_orderkey n, [] st, ['O' || o_orderkey] es, [] rs, '(O' || o_orderkey || ')' tx from orders where o_orderkey in (select qid from a_entities)),
""" + ",\n".join(f"""  s{i} as (select gid, m n, st, es, rs, tx from (select *, row_number() over (partition by gid, m order by st) k from (
    select s.gid, e.m, list_concat(s.st, [e.dir * 1000000 + e.triple_idx]) st, list_concat(s.es, [e.m]) es, list_concat(s.rs, [e.rel]) rs,
      s.tx || case when e.dir = 0 then ' --[' || e.rel || ']--> (' else ' <--[' || e.rel || ']-- (' end || e.m || ')' tx
    from s{i - 1} s join e on e.gid = s.gid and e.n = s.n) x) y where k = 1)""" for i in (1, 2, 3, 4)) + """,
  bfs as (""" + " union all ".join(f"select gid qid, {i} depth, st, es, rs, tx, n target from s{i} where exists (select 1 from a_entities a where a.qid = gid and a.entity = n)" for i in (1, 2, 3, 4)) + ")"


def _with_bfs(body):
    return with_tables("subgraphs", "a_entities", body="@").replace(") @", f"), {_BFS} {body}")


@query("bfs_paths_undirected", _with_bfs("select qid, depth, array_to_string(es, '|') entities, array_to_string(rs, ' -> ') relation_chain, tx full_path from bfs"))
def _(spark, d):
    q, a = own_ends(spark, d)
    p = P.bfs_paths_undirected(q, a, K.subgraphs(spark, d), 4, by_graph=True)
    p = p.withColumn("full_path", S.full_path(F.col("entities"), F.col("relations"), F.col("forward")))
    return p.select("qid", "depth", text("entities").alias("entities"), S.relation_chain(F.col("relations")).alias("relation_chain"), "full_path")


@query("select_paths", _with_bfs(""", k1 as (select * from (select *, row_number() over (partition by qid, target order by depth, st) k from bfs) x where k <= 3),
  k2 as (select *, row_number() over (partition by qid order by depth, st) no from k1)
  select qid, cast(no as bigint) path_no, tx full_path from k2 where no <= 4"""))
def _(spark, d):
    q, a = own_ends(spark, d)
    p = P.bfs_paths_undirected(q, a, K.subgraphs(spark, d), 4, enough=None, by_graph=True)
    return P.select_paths(p, ["pos", "steps"], 3, 4).select("qid", F.col("path_no").cast("bigint").alias("path_no"), "full_path")


@query("connecting_paths", _with_three(""", once as (select *, row_number() over (partition by qid, rels, ents[-1] order by i1, i2, i3) k from (
    select f.*, g.triple_idx i1, h.triple_idx i2, i.triple_idx i3 from found f
    join subgraphs g on g.gid = qid and g.subj = ents[1] and g.rel = rels[1] and g.obj = ents[2]
    join subgraphs h on h.gid = qid and h.subj = ents[2] and h.rel = rels[2] and h.obj = ents[3]
    join subgraphs i on i.gid = qid and i.subj = ents[3] and i.rel = rels[3] and i.obj = ents[4]
    where ents[-1] = (select min(entity) from a_entities a where a.qid = f.qid)) x)
  select qid, cast(no as bigint) as no, array_to_string(ents, '|') entities, array_to_string(rels, ' -> ') path_string from (
    select *, row_number() over (partition by qid order by i1, i2, i3) no from once where k = 1) y where no <= 10"""))
def _(spark, d):
    q, a = own_ends(spark, d)
    pairs = q.select("qid", "gid", F.col("entity").alias("start")).join(a.groupBy("qid").agg(F.min("entity").alias("end")), "qid")
    return P.connecting_paths(pairs, K.subgraphs(spark, d), max_paths=10, by_graph=True).select(
        "qid", F.col("no").cast("bigint").alias("no"), text("entities").alias("entities"), "path_string")


@query("all_shortest_paths", _with_three("select qid, array_to_string(ents, '|') entities, array_to_string(rels, ' -> ') relation_chain from found"))
def _(spark, d):
    q, a = own_ends(spark, d)
    return P.all_shortest_paths(q, a, K.subgraphs(spark, d), by_graph=True).select("qid", text("entities").alias("entities"), "relation_chain")


@query("path_triples", with_tables("paths", "subgraphs", body="""select p.qid, p.path_no, cast(i - 1 as integer) step, g.subj, g.rel, g.obj, g.triple_idx
from paths p, lateral (select unnest(range(1, len(relations) + 1)) i) u
join subgraphs g on g.gid = p.qid and g.subj = p.entities[u.i] and g.rel = p.relations[u.i] and g.obj = p.entities[u.i + 1]"""))
def _(spark, d):
    p = K.paths(spark, d).withColumn("gid", F.col("qid"))
    out = P.path_triples(p, K.subgraphs(spark, d))
    return out.select("qid", F.col("path_no").cast("bigint").alias("path_no"), "step", "subj", "rel", "obj", "triple_idx")
