"""Catalogue of queries: a Spark callable and, where one exists, the same query as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CTES = {
    "triples": """select cast(0 as bigint) gid, subj, rel, obj, cast(row_number() over (partition by subj order by rel, obj) - 1 as int) triple_idx from (
  select 'C' || cast(c_custkey as varchar) subj, 'customer.customer.nation' rel, n_name obj from customer join nation on c_nationkey = n_nationkey
  union all select n_name, 'nation.nation.region', r_name from nation join region on n_regionkey = r_regionkey
  union all select 'S' || cast(s_suppkey as varchar), 'supplier.supplier.nation', n_name from supplier join nation on s_nationkey = n_nationkey
  union all select 'O' || cast(o_orderkey as varchar), 'order.order.customer', 'C' || cast(o_custkey as varchar) from orders
  union all select distinct 'O' || cast(l_orderkey as varchar), 'order.order.supplier', 'S' || cast(l_suppkey as varchar) from lineitem
  union all select distinct 'O' || cast(l_orderkey as varchar), 'order.order.part', 'P' || cast(l_partkey as varchar) from lineitem
  union all select 'P' || cast(p_partkey as varchar), 'part.part.brand', p_brand from part) x""",
    "bought": """select o_orderkey gid, 'O' || o_orderkey o, 'C' || c_custkey c, n_name, r_name from orders join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "sold": """select distinct l_orderkey gid, 'O' || l_orderkey o, 'S' || s_suppkey s, n_name, r_name from lineitem join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "bits": "select distinct l_orderkey gid, 'O' || l_orderkey o, 'P' || p_partkey p, p_brand from lineitem join part on l_partkey = p_partkey",
    "subgraphs": """select gid, subj, rel, obj, cast(row_number() over (partition by gid order by rel, subj, obj) - 1 as int) triple_idx from (
  select gid, o subj, 'order.order.customer' rel, c obj from bought
  union select gid, c, 'customer.customer.nation', n_name from bought
  union select gid, o, 'order.order.supplier', s from sold
  union select gid, s, 'supplier.supplier.nation', n_name from sold
  union select gid, n_name, 'nation.nation.region', r_name from bought
  union select gid, n_name, 'nation.nation.region', r_name from sold
  union select gid, o, 'order.order.part', p from bits
  union select gid, p, 'part.part.brand', p_brand from bits) x""",
    "questions": """select o_orderkey qid, cast(0 as bigint) gid, case left(o_orderpriority, 1)
  when '1' then 'what country is the customer of O' || o_orderkey || ' from ?'
  when '2' then 'how many parts does O' || o_orderkey || ' have'
  when '3' then 'What kind of brand is linked to O' || o_orderkey || ' !'
  else 'which region supplies order O' || o_orderkey || ' ?' end question from orders""",
    "q_entities": "select o_orderkey qid, 1 pos, 'O' || cast(o_orderkey as varchar) entity from orders",
    "a_entities": """select qid, row_number() over (partition by qid order by entity) pos, entity from (
  select distinct l_orderkey qid, r_name entity from lineitem join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey) x""",
    "chains": """select cast(path_id as bigint) path_id, path from (values
  (0, 'order.order.supplier -> supplier.supplier.nation -> nation.nation.region'),
  (1, 'order.order.customer -> customer.customer.nation -> nation.nation.region'),
  (2, 'order.order.supplier -> supplier.supplier.nation'),
  (3, 'order.order.customer -> customer.customer.nation'),
  (4, 'order.order.supplier'), (5, 'order.order.customer'),
  (6, 'order.order.part -> part.part.brand'), (7, 'order.order.part')) t(path_id, path)""",
    "ranked": """select qid, 'retrieved' source, row_number() over (partition by qid order by h, path_id) as rank,
  cast(1 as double) / row_number() over (partition by qid order by h, path_id) score, path_id, path
  from (select o_orderkey qid, path_id, path, md5('42|' || o_orderkey || '|' || path_id) h from orders cross join chains) x""",
    "ranked2": """select qid, 'generated' source, row_number() over (partition by qid order by h, path_id) as rank,
  cast(1 as double) / row_number() over (partition by qid order by h, path_id) score, path_id, path
  from (select o_orderkey qid, path_id, path, md5('7|' || o_orderkey || '|' || path_id) h from orders cross join chains) x""",
    "gold": """select o_orderkey qid, 0 path_no, 'order.order.supplier -> supplier.supplier.nation -> nation.nation.region' path from orders
  union all select o_orderkey, 1, 'order.order.customer -> customer.customer.nation -> nation.nation.region' from orders where o_orderstatus = 'F'""",
    "answers": """select qid, sample_no, r_name answer from (
  select o_orderkey qid, sample_no, r_name, row_number() over (partition by o_orderkey, sample_no order by md5(o_orderkey || '|' || sample_no || '|' || r_name)) k
  from orders cross join (values (0), (1), (2), (3), (4)) s(sample_no) cross join region) x where k = 1""",
    "path_rows": """select gid qid, [o, c] entities, ['order.order.customer'] relations, '(' || o || ') --[order.order.customer]--> (' || c || ')' full_path from bought
  union all select gid, [o, c, n_name], ['order.order.customer', 'customer.customer.nation'],
    '(' || o || ') --[order.order.customer]--> (' || c || ') --[customer.customer.nation]--> (' || n_name || ')' from bought
  union all select gid, [o, s, n_name, r_name], ['order.order.supplier', 'supplier.supplier.nation', 'nation.nation.region'],
    '(' || o || ') --[order.order.supplier]--> (' || s || ') --[supplier.supplier.nation]--> (' || n_name || ') --[nation.nation.region]--> (' || r_name || ')' from sold
  union all select gid, [o, p, p_brand], ['order.order.part', 'part.part.brand'],
    '(' || o || ') --[order.order.part]--> (' || p || ') --[part.part.brand]--> (' || p_brand || ')' from bits""",
    "paths": """select qid, cast(row_number() over (partition by qid order by full_path) - 1 as bigint) path_no, entities, relations,
  array_to_string(relations, ' -> ') relation_chain, full_path from path_rows""",
    "samples": """select q.qid id, question, [q.entity] q_entity,
  coalesce(a.l, []) a_entity, coalesce(a.l, []) answer, coalesce(g.l, []) graph, coalesce(p.l, []) paths
  from (select questions.qid, question, entity from questions join q_entities using (qid)) q
  left join (select qid, list(entity order by pos) l from a_entities group by qid) a on q.qid = a.qid
  left join (select gid, list({'subj': subj, 'rel': rel, 'obj': obj} order by triple_idx) l from subgraphs group by gid) g on q.qid = g.gid
  left join (select qid, list({'full_path': full_path, 'relation_chain': relation_chain, 'entities': entities, 'relations': relations} order by path_no) l
    from paths group by qid) p on q.qid = p.qid""",
}
NEEDS = {
    "subgraphs": ["bought", "sold", "bits"], "ranked": ["chains"], "ranked2": ["chains"],
    "path_rows": ["bought", "sold", "bits"], "paths": ["path_rows"],
    "samples": ["questions", "q_entities", "a_entities", "subgraphs", "paths"],
}


def with_tables(*names: str, body: str, **extra: str) -> str:
    """SQL text with the named canonical tables (and what they need) in front; ``extra`` adds local ones."""
    done: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in done:
            done.append(name)

    for n in names:
        add(n)
    parts = [f"{n} as ({CTES[n]})" for n in done] + [f"{n} as ({sql})" for n, sql in extra.items()]
    return f"with {', '.join(parts)} {body}" if parts else body


def query(name: str, oracle: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep
