"""Queries over ranked lists, metrics and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import answers as A
from ..operators import filters as B
from ..operators import metrics as M
from ..operators import ranking as R
from ..operators import reports as P
from ..plans import canonical as K
from ..session import beside
from .core import query, with_tables

big = lambda df: df.select(*[F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])
lists = lambda s, d: (K.ranked(s, d), K.ranked(s, d, "generated", "7"))
sql = with_tables


def voted(spark, d):
    return A.majority_vote(K.answers(spark, d)).select("qid", "answer")


def extra(spark, d):
    """A second score per (question, path): a fixed hash fraction."""
    h = F.conv(F.substring(B.seeded("x", "qid", "path_id"), 1, 6), 16, 10).cast("double") / 16777216
    return K.ranked(spark, d).select("qid", "path_id", h.alias("extra"))


EXTRA = "select qid, path_id, cast(('0x' || substr(md5('x|' || qid || '|' || path_id), 1, 6)) as bigint) / 16777216.0::double extra from ranked"
FREQ = "select path_id, count(*) frequency from ranked where rank <= 3 group by path_id"
freq = lambda s, d: K.ranked(s, d).filter("rank <= 3").groupBy("path_id").agg(F.count(F.lit(1)).alias("frequency"))
_TOP = "select qid, k as rank, {cols} from (select *, row_number() over (partition by qid order by round(s, 12) desc, path_id) k from ({inner}) x) y where k <= {k}"


@query("top_k", sql("ranked2", body="select qid, rank, score, path_id from ranked2 where rank <= 3"))
def _(s, d):
    return big(R.top_k(lists(s, d)[1].drop("rank"), 3).select("qid", "rank", "score", "path_id"))


@query("rerank", sql("ranked", "ranked2", body="select qid, k as rank, path_id from (select qid, path_id, row_number() over (partition by qid order by score desc, path_id) k from ranked2) x where k <= 5"))
def _(s, d):
    a, b = lists(s, d)
    return big(R.rerank(a, b, 5).select("qid", "rank", "path_id"))


@query("min_score", sql("ranked", body="select qid, path_id, score from ranked where score >= 0.25"))
def _(s, d):
    return B.min_score(K.ranked(s, d), 0.25).select("qid", "path_id", "score")


@query("filter_by_relations", sql("ranked", body="select qid, path_id from ranked where list_has_any(string_split(path, ' -> '), ['part.part.brand', 'customer.customer.nation'])"))
def _(s, d):
    return B.filter_by_relations(K.ranked(s, d), [K.PART_BRAND, K.CUSTOMER_NATION]).select("qid", "path_id")


QTYPES = """select qid, case when question ilike 'how many%' then 1 when question ilike 'what kind of%' then 1 when question like 'what country%' then 1 else 2 end min_hops,
  case when question ilike 'how many%' then 1 when question ilike 'what kind of%' then 1 when question like 'what country%' then 2 else 5 end max_hops,
  case when question ilike 'how many%' then 'literal' when question ilike 'what kind of%' then 'definitional' when question like 'what country%' then 'one_hop' else 'two_hop' end qtype,
  case when question like 'what country%' then 0.6 else 0.8 end confidence from questions"""


def qtypes(s, d):
    q = F.col("question")
    pick = lambda a, b, c, e: F.when(q.like("how many%"), a).when(q.like("What kind of%"), b).when(q.like("what country%"), c).otherwise(e)
    return K.questions(s, d).select("qid", pick(1, 1, 1, 2).alias("min_hops"), pick(1, 1, 2, 5).alias("max_hops"),
                                    pick("literal", "definitional", "one_hop", "two_hop").alias("qtype"), pick(0.8, 0.8, 0.6, 0.8).alias("confidence"))


@query("hop_filter", sql("ranked", "questions", t=QTYPES, body="""select qid, path_id, original_count, case when applied then fit else original_count end filtered_count, applied from (
  select r.qid, path_id, len(string_split(path, ' -> ')) between min_hops and max_hops ok, count(*) over (partition by r.qid) original_count,
    count(*) filter (where len(string_split(path, ' -> ')) between min_hops and max_hops) over (partition by r.qid) fit,
    count(*) filter (where len(string_split(path, ' -> ')) between min_hops and max_hops) over (partition by r.qid) >= 4 applied
  from ranked r join t using (qid)) x where ok or not applied"""))
def _(s, d):
    return B.hop_filter(K.ranked(s, d), qtypes(s, d), 4).select("qid", "path_id", "original_count", "filtered_count", "applied")


@query("hop_filter_by_type", sql("ranked", "questions", t=QTYPES, body="""select r.qid, path_id from ranked r join t using (qid)
  where len(string_split(path, ' -> ')) between (case qtype when 'two_hop' then 2 else 1 end) and (case qtype when 'two_hop' then 5 when 'one_hop' then 2 else 1 end)"""))
def _(s, d):
    return B.hop_filter_by_type(K.ranked(s, d), qtypes(s, d)).select("qid", "path_id")


@query("hop_filter_confidence", sql("ranked", "questions", t=QTYPES, body="""select r.qid, path_id from ranked r join t using (qid) where case when confidence >= 0.7
  then len(string_split(path, ' -> ')) between min_hops and max_hops else len(string_split(path, ' -> ')) between greatest(1, min_hops - 1) and max_hops + 1 end"""))
def _(s, d):
    return B.hop_filter_confidence(K.ranked(s, d), qtypes(s, d)).select("qid", "path_id")


@query("hop_histogram", sql("ranked", body="select cast(len(string_split(path, ' -> ')) as bigint) hops, count(*) n from ranked group by 1"))
def _(s, d):
    return big(P.hop_histogram(K.ranked(s, d)))


@query("hop_summary", sql("ranked", body="select min(len(string_split(path, ' -> '))) min_hops, max(len(string_split(path, ' -> '))) max_hops, round(avg(len(string_split(path, ' -> '))), 6) avg_hops from ranked"))
def _(s, d):
    return big(P.hop_summary(K.ranked(s, d)))


@query("rrf_fuse", sql("ranked", "ranked2", body="""select qid, k as rank, score, path_id from (select *, row_number() over (partition by qid order by score desc, r0, r1, path_id) k from (
  select a.qid, a.path_id, round(cast(1 as double) / (60 + a.rank) + cast(1 as double) / (60 + b.rank), 12) score, a.rank r0, b.rank r1 from ranked a join ranked2 b using (qid, path_id)) x) y where k <= 5"""))
def _(s, d):
    return big(R.rrf_fuse(list(lists(s, d)), 5))


@query("minmax_fuse", sql("ranked", "ranked2", body=_TOP.format(k=5, cols="round(s, 12) score, path_id", inner="""
  select qid, path_id, 0.3 * coalesce((a.score - 0.2) / 0.8, 0) + 0.7 * coalesce((b.score - 0.25) / 0.75, 0) s
  from (select * from ranked where rank <= 5) a full join (select * from ranked2 where rank <= 4) b using (qid, path_id)""")))
def _(s, d):
    a, b = lists(s, d)
    return big(R.minmax_fuse(a.filter("rank <= 5"), b.filter("rank <= 4"), 5, 0.7))


@query("fuse_full_corpus_minmax", sql("ranked", "ranked2", body=_TOP.format(k=4, cols="round(s, 12) score, path_id", inner="""
  select a.qid, a.path_id, 0.5 * (a.score - 0.125) / (0.875 + 1e-9) + 0.5 * coalesce((b.score - cast(1 as double) / 3) / (cast(1 as double) - cast(1 as double) / 3 + 1e-9), 0) s
  from ranked a left join (select * from ranked2 where rank <= 3) b using (qid, path_id)""")))
def _(s, d):
    a, b = lists(s, d)
    return big(R.fuse_full_corpus(b.filter("rank <= 3"), a, 4))


@query("fuse_full_corpus_scaled", sql("ranked", "ranked2", body=_TOP.format(k=4, cols="round(s, 12) score, path_id", inner="""
  select a.qid, a.path_id, 0.3 * a.score + 0.7 * coalesce(b.score, 0) s from ranked a left join (select * from ranked2 where rank <= 3) b using (qid, path_id)""")))
def _(s, d):
    a, b = lists(s, d)
    return big(R.fuse_full_corpus(b.filter("rank <= 3"), a, 4, "scaled"))


@query("fuse_two_views", sql("ranked", "ranked2", body=_TOP.format(k=5, cols="round(s, 12) score, path_id", inner="""
  select qid, path_id, 0.5 * coalesce(a.score, -100) + 0.5 * coalesce(b.score, -100) s
  from (select * from ranked where rank <= 5) a full join (select * from ranked2 where rank <= 4) b using (qid, path_id)""")))
def _(s, d):
    a, b = lists(s, d)
    return big(R.fuse_two_views(a.filter("rank <= 5"), b.filter("rank <= 4"), 5))


_B = "(select *, min(extra) over (partition by qid) lo, max(extra) over (partition by qid) hi from ranked join x using (qid, path_id))"


@query("blend_scores", sql("ranked", x=EXTRA, body=_TOP.format(k=5, cols="round(s, 12) score, path_id", inner=f"select qid, path_id, 0.7 * score + 0.3 * (extra - lo) / (hi - lo) s from {_B}")))
def _(s, d):
    return big(R.blend_scores(K.ranked(s, d), extra(s, d), 5).select("qid", "rank", "score", "path_id"))


@query("ensemble_rank", sql("ranked", x=EXTRA, f=FREQ, body=_TOP.format(k=5, cols="round(s, 12) score, path_id", inner=f"""
  select qid, path_id, 0.4 * (score - 0.125) / 0.875 + 0.3 * (extra - lo) / (hi - lo) + 0.3 * (frequency - (select min(frequency) from f)) / ((select max(frequency) from f) - (select min(frequency) from f))::double s
  from {_B} join f using (path_id)""")))
def _(s, d):
    return big(R.ensemble_rank(K.ranked(s, d), extra(s, d), freq(s, d), 5).select("qid", "rank", "score", "path_id"))


@query("frequency_boost", sql("ranked", f=FREQ, body=_TOP.format(k=5, cols="round(s, 12) score, path_id", inner="select qid, path_id, score + least(0.1, frequency / 1000.0::double) s from ranked join f using (path_id)")))
def _(s, d):
    return big(R.frequency_boost(K.ranked(s, d), freq(s, d), 5).select("qid", "rank", "score", "path_id"))


@query("keyword_boost", sql("ranked", "questions", body=_TOP.format(k=3, cols="round(s, 12) score, path_id", inner="""
  select qid, path_id, score + 0.1 * len(list_filter(string_split(lower(question), ' '), lambda w: contains(lower(path), w))) s from ranked join questions using (qid) where rank <= 6""")))
def _(s, d):
    words = K.questions(s, d).select("qid", F.split(F.lower("question"), " ").alias("words"))
    return big(R.keyword_boost(K.ranked(s, d), words, 3).select("qid", "rank", "score", "path_id"))


@query("jaccard_rank", sql("ranked", body=_TOP.format(k=4, cols="s as score, path_id", inner="""
  select qid, path_id, len(list_intersect(string_split(path, ' -> '), w)) / len(list_distinct(list_concat(string_split(path, ' -> '), w)))::double s
  from ranked join (select qid, string_split(path, ' -> ') w from ranked where rank = 1) t using (qid)""")))
def _(s, d):
    r = K.ranked(s, d)
    wanted = r.filter("rank = 1").select("qid", F.split("path", " -> ").alias("relations"))
    return big(R.jaccard_rank(r, wanted, 4).select("qid", "rank", "score", "path_id"))


@query("ordered_dedupe", sql("ranked", body="select qid, rank, path_id from (select *, row_number() over (partition by qid, string_split(path, ' -> ')[1] order by rank) k from ranked) x where k = 1"))
def _(s, d):
    r = R.ordered_dedupe(K.ranked(s, d), F.substring_index("path", " -> ", 1), ["rank"])
    return big(r.select("qid", "rank", "path_id"))


@query("combine_paths", sql("ranked", "ranked2", body="""select qid, k as pos, path_id, cast(list_no as bigint) list_no from (select *, row_number() over (partition by qid order by list_no, rank) k from (
  select qid, path_id, min(list_no) list_no, arg_min(rank, list_no) as rank from (select qid, path_id, rank, 0 list_no from ranked where rank <= 4
    union all select qid, path_id, rank, 1 from ranked2) x group by qid, path_id) y) z where k <= 6"""))
def _(s, d):
    a, b = lists(s, d)
    return big(R.combine_paths(a.filter("rank <= 4"), b, 6).select("qid", "pos", "path_id", "list_no"))


@query("union_retrieval", sql("ranked", "ranked2", body="""select qid, k as pos, path_id from (select *, row_number() over (partition by qid order by list_no, rank) k from (
  select qid, path_id, min(list_no) list_no, arg_min(rank, list_no) as rank from (select qid, path_id, rank, 0 list_no from ranked where rank <= 4
    union all select qid, path_id, rank, 1 from ranked2 where rank <= 5) x group by qid, path_id) y) z where k <= 15"""))
def _(s, d):
    a, b = lists(s, d)
    return big(R.union_retrieval(a.filter("rank <= 4"), b.filter("rank <= 5"), 15).select("qid", "pos", "path_id"))


_FIRST = "select qid, min(rank) first_rank from ranked join gold using (qid, path) group by qid"


@query("match_rank", sql("ranked", "gold", m=_FIRST, body="select qid, first_rank, first_rank = 1 top1, first_rank <= 5 top5 from m"))
def _(s, d):
    return big(R.match_rank(K.ranked(s, d), K.gold(s, d)))


@query("promote_match", sql("ranked", "gold", m=_FIRST, body="""select qid, row_number() over (partition by qid order by coalesce(rank = first_rank and rank <= 5, false) desc, rank) pos, path_id,
  coalesce(rank = first_rank and rank <= 5, false) is_match from ranked left join m using (qid) where rank <= 3 or (rank = first_rank and rank <= 5)"""))
def _(s, d):
    return big(R.promote_match(K.ranked(s, d), K.gold(s, d)).select("qid", "pos", "path_id", "is_match"))


@query("promote_picks", sql("ranked", body="""select qid, k as pos, path_id from (select qid, path_id, row_number() over (partition by qid order by case rank when 3 then 1 when qid % 8 + 1 then 2 else 9 end, rank) k from ranked) x where k <= 5"""))
def _(s, d):
    r = K.ranked(s, d)
    picks = r.select("qid").distinct().select("qid", F.array(F.lit(3), F.lit(99), (F.col("qid") % 8 + 1).cast("int")).alias("picks"))
    return big(R.promote_picks(r, picks).select("qid", "pos", "path_id"))


@query("promote_single_pick", sql("ranked", body="select qid, path_id from ranked where rank = case when qid % 12 between 1 and 8 then qid % 12 else 1 end"))
def _(s, d):
    r = K.ranked(s, d)
    picks = r.select("qid").distinct().select("qid", (F.col("qid") % 12).cast("int").alias("pick"))
    return R.promote_single_pick(r, picks).select("qid", "path_id")


@query("score_generated", sql("ranked", "ranked2", w="select r.qid, rel, sum(score) w from ranked r, lateral (select unnest(list_distinct(string_split(path, ' -> '))) rel) u where rank <= 3 group by 1, 2",
       g="select qid, rank as pos, string_split(path, ' -> ') rels from ranked2 where rank <= 3 union all select qid, 10 + rank, string_split(path, ' -> ') from ranked2 where rank <= 2 union all select qid, 20, list_reverse(string_split(path, ' -> ')) from ranked2 where rank = 1",
       body="""select qid, pos, round(greatest(0.1, (1 + 0.1 * coalesce((select sum(w) from w where w.qid = g.qid and list_contains(g.rels, w.rel)), 0)
  - 0.5 * (select count(*) from g h where h.qid = g.qid and h.pos < g.pos and h.rels = g.rels)
  - 0.2 * (select count(*) from g h where h.qid = g.qid and h.pos < g.pos and h.rels <> g.rels and list_sort(h.rels) = list_sort(g.rels)))
  * len(list_distinct(rels)) / len(rels)), 12) score from g"""))
def _(s, d):
    a, b = lists(s, d)
    one = lambda cut, pos, rel: b.filter(cut).select("qid", pos.cast("bigint").alias("pos"), rel.alias("relations"))
    rel = F.split("path", " -> ")
    g = one("rank <= 3", F.col("rank"), rel).unionByName(one("rank <= 2", F.col("rank") + 10, rel)).unionByName(one("rank = 1", F.lit(20), F.reverse(rel)))
    return R.score_generated(g, a.filter("rank <= 3")).select("qid", "pos", "score")


@query("blend_fixed_range", sql("ranked", x=EXTRA, body=_TOP.format(k=5, cols="round(s, 12) score, path_id", inner="select qid, path_id, 0.7 * score + 0.3 * (case when extra < 0.2 then -10 else -extra * 10 end + 10) / 10 s from ranked join x using (qid, path_id)")))
def _(s, d):
    e = extra(s, d).withColumn("extra", F.when(F.col("extra") < 0.2, F.lit(float("nan"))).otherwise(-F.col("extra") * 10))
    return big(R.blend_fixed_range(K.ranked(s, d), e, 5).select("qid", "rank", "score", "path_id"))


@query("diverse_paths", sql("paths", body="""select qid, no, full_path from (select *, row_number() over (partition by qid order by len(relations), path_no) no from (
  select *, row_number() over (partition by qid, entities[-1] order by len(relations), path_no) k from paths) x where k = 1) y where no <= 5"""))
def _(s, d):
    return big(R.diverse_paths(K.paths(s, d), ["path_no"], 5).select("qid", "no", "full_path"))


@query("cap_paths_per_target", sql("paths", body="""select qid, no path_no, full_path from (select *, row_number() over (partition by qid order by len(relations), full_path) no from (
  select *, row_number() over (partition by qid, entities[-1] order by len(relations), full_path) k from paths) x where k <= 1) y where no <= 6"""))
def _(s, d):
    return big(R.cap_paths_per_target(K.paths(s, d).drop("path_no"), ["full_path"], 1, 6).select("qid", "path_no", "full_path"))


@query("shortest_covering_paths", sql("paths", "a_entities", ans="select qid, entity from a_entities union select qid, lower(p.entities[-1])[2:] from paths p where p.relations[1] = 'order.order.part'",
  t="select *, lower(entities[-1]) target from paths", b="select * from (select *, row_number() over (partition by qid, target order by len(relations), path_no) k, min(path_no) over (partition by qid, target) seen from t) x where k = 1",
  hit="select b.qid, 0 late, lower(a.entity) via, b.path_no, b.full_path from ans a join b on a.qid = b.qid and lower(a.entity) = b.target",
  far="""select qid, 1 late, via, path_no, full_path from (select a.qid, lower(a.entity) via, b.path_no, b.full_path, row_number() over (partition by a.qid, lower(a.entity) order by b.seen) k
    from ans a join b on a.qid = b.qid and (contains(b.target, lower(a.entity)) or contains(lower(a.entity), b.target))
    where not exists (select 1 from b b2 where b2.qid = a.qid and b2.target = lower(a.entity))) y where k = 1""",
  body="select qid, full_path, count(*) n from (select *, row_number() over (partition by qid, full_path order by late, via) k from (select * from hit union all select * from far) u) v where k = 1 group by 1, 2"))
def _(s, d):
    p = K.paths(s, d)
    more = p.filter(F.get("relations", F.lit(0)) == K.TO_PART).select("qid", F.expr("substring(lower(element_at(entities, -1)), 2)").alias("entity"))
    ans = K.a_entities(s, d).select("qid", "entity").union(more)  # repeats make no difference
    return R.shortest_covering_paths(p, ans).groupBy("qid", "full_path").agg(F.count(F.lit(1)).alias("n"))


# --- metrics ---

_PERQ = """g as (select distinct qid, path from gold), m as (select g.qid, g.path, r.rank from g left join ranked r using (qid, path)),
  q as (select qid, """ + ", ".join(f"avg(case when rank <= {k} then 1.0 else 0.0 end) recall_{k}, max(case when rank <= {k} then 1.0 else 0.0 end) hits_{k}" for k in M.KS) + """,
    coalesce(1.0::double / min(rank), 0) rr from m group by qid)"""


def _with_q(*names, body):
    return with_tables("ranked", "gold", *names, body="@").replace(") @", f"), {_PERQ} {body}")


_avg = lambda cols: ", ".join(f"round(avg({c}), 6) {c}" for c in cols)


@query("recall_at_k", _with_q(body=f"select {_avg([f'recall_{k}' for k in M.KS])} from q"))
def _(s, d):
    return M.recall_at_k(K.ranked(s, d), K.gold(s, d))


@query("hits_at_k", _with_q(body=f"select {_avg([f'hits_{k}' for k in M.KS])} from q"))
def _(s, d):
    return M.hits_at_k(K.ranked(s, d), K.gold(s, d), norm="lower")


@query("hits_at_k_all_questions", _with_q(body="select round(sum(case when qid in (select qid from a_entities) then hits_5 else 0 end) / count(*), 6) hits_5 from q").replace("with ", f"with a_entities as (select distinct l_orderkey qid from lineitem), ", 1))
def _(s, d):
    gold = K.gold(s, d).join(K.a_entities(s, d).select("qid").distinct(), "qid", "left_semi")
    return M.hits_at_k(K.ranked(s, d), gold, [5], "exact", K.questions(s, d))


@query("mrr", _with_q(body="select round(avg(rr), 6) mrr from q"))
def _(s, d):
    return M.mrr(K.ranked(s, d), K.gold(s, d))


@query("retrieval_report", _with_q(body=f"select {_avg([f'recall_{k}' for k in M.KS] + [f'hits_{k}' for k in M.KS] + ['rr'])} from q"))
def _(s, d):
    return M.retrieval_report(K.ranked(s, d), K.gold(s, d))


_OV = "m as (select r.qid, r.rank, g.path_no, len(list_intersect(string_split(r.path, ' -> '), string_split(g.path, ' -> '))) / len(string_split(g.path, ' -> '))::double ov, list_sort(string_split(r.path, ' -> ')) = list_sort(string_split(g.path, ' -> ')) eq, r.path p, g.path gp from ranked r join gold g using (qid))"


def _with_ov(body):
    return with_tables("ranked", "gold", body="@").replace(") @", f"), {_OV} {body}")


@query("relation_hits_at_k", _with_ov("select round(avg(h), 6) relation_hits_3 from (select qid, max(case when rank <= 3 and (eq or ov >= 0.8) then 1 else 0 end) h from m group by qid) x"))
def _(s, d):
    return M.relation_hits_at_k(K.ranked(s, d), K.gold(s, d), K.questions(s, d), 3)


@query("relation_recall", _with_ov("""select round(avg(case when e is not null then 1 else 0 end), 6) exact_recall, round(avg(case when p is not null and (e is null or p < e) then 1 else 0 end), 6) partial_recall,
  round(avg(case when e is not null then 1 else b end), 6) avg_relation_overlap from (select qid, min(path_no) filter (where eq) e, min(path_no) filter (where not eq and ov >= 0.5) p, max(ov) b from m where rank = 1 group by qid) x"""))
def _(s, d):
    return M.relation_recall(K.ranked(s, d), K.gold(s, d), K.questions(s, d))


@query("chain_accuracy", _with_ov("""select count(*) with_gold, round(avg(case when v = 'exact' then 1 else 0 end), 6) relation_chain_accuracy, round(avg(case when v = 'partial' then 1 else 0 end), 6) partial_relation_match
  from (select qid, arg_min(case when p = gp then 'exact' when ov > 0.5 then 'partial' end, path_no) filter (where p = gp or ov > 0.5) v from m where rank = 1 group by qid) x"""))
def _(s, d):
    return M.chain_accuracy(K.ranked(s, d).filter("rank = 1"), K.gold(s, d))


@query("path_count_accuracy", sql("paths", "a_entities", body="""select round(avg(case when p = g or (g = 0 and p = 1) then 1 else 0 end), 6) path_count_accuracy, round(avg(p), 6) avg_predicted, round(avg(g), 6) avg_gold
  from (select o_orderkey, (select count(*) from paths where qid = o_orderkey and len(relations) = 3) p, (select count(*) from a_entities where qid = o_orderkey) g from orders) x"""))
def _(s, d):
    n = lambda df, c: df.groupBy("qid").agg(F.count(F.lit(1)).alias(c))
    c = K.questions(s, d).select("qid").join(n(K.paths(s, d).filter(F.size("relations") == 3), "predicted"), "qid", "left").join(n(K.a_entities(s, d), "gold"), "qid", "left")
    return M.path_count_accuracy(c.fillna(0))


RETR = "select distinct gid qid, n_name entity from bought union select gid, r_name from bought"


def candidates(s, d):
    """Nation and region of the customer."""
    sub = K.subgraphs(s, d)
    hop = sub.filter(F.col("rel") == K.CUSTOMER_NATION).select("gid", "obj")
    up = sub.filter(F.col("rel") == K.NATION_REGION).select("gid", F.col("subj").alias("obj"), F.col("obj").alias("r"))
    return hop.select(F.col("gid").alias("qid"), F.col("obj").alias("entity")).union(hop.join(beside(up), ["gid", "obj"]).select("gid", "r")).distinct()


@query("entity_hits_at_k", sql("bought", "a_entities", r=RETR, body="""select round(avg(h), 6) entity_hits_1 from (select a.qid, max(case when lower(a.entity) = lower(t.e) then 1 else 0 end) h from a_entities a
  left join (select qid, min(entity) e from r group by qid) t on t.qid = a.qid group by a.qid) x"""))
def _(s, d):
    return M.entity_hits_at_k(candidates(s, d), K.a_entities(s, d), 1)


@query("entity_recall", sql("bought", "a_entities", r=RETR, body="""select round(sum(c) / sum(g)::double, 6) entity_recall, round(avg(case when c = g and c = n then 1 else 0 end), 6) exact_match_rate,
  round(avg(case when not (c = g and c = n) and c > 0 then 1 else 0 end), 6) partial_match_rate, count(*) total_samples from (
  select a.qid, count(*) g, count(r.entity) c, max((select count(*) from r r2 where r2.qid = a.qid)) n from a_entities a left join r on r.qid = a.qid and r.entity = a.entity group by a.qid) x"""))
def _(s, d):
    return M.entity_recall(candidates(s, d), K.a_entities(s, d))


@query("candidate_recall", sql("bought", "a_entities", r=RETR, body="select round(avg(h), 6) candidate_recall from (select a.qid, max(case when r.entity is not null then 1 else 0 end) h from a_entities a left join r on r.qid = a.qid and r.entity = a.entity group by a.qid) x"))
def _(s, d):
    return M.candidate_recall(candidates(s, d), K.a_entities(s, d))


@query("source_contribution", sql("ranked", "ranked2", body="""select round(avg(a), 6) from_retrieval, round(avg(b), 6) from_generation from (select r.qid, avg(case when x.path is null then 0 else 1 end) a, avg(case when y.path is null then 0 else 1 end) b
  from (select * from ranked where rank between 3 and 6) r left join (select * from ranked where rank <= 4) x using (qid, path) left join (select * from ranked2 where rank <= 4) y using (qid, path) group by r.qid) z"""))
def _(s, d):
    a, b = lists(s, d)
    return M.source_contribution(a.filter("rank between 3 and 6"), a.filter("rank <= 4"), b.filter("rank <= 4"))


@query("subgraph_id_recall", sql("ranked", "gold", m="select g.qid, g.path, r.rank from gold g left join ranked r using (qid, path)", body="""select (select count(distinct qid) from m) total_with_gold, """ + ", ".join(
    f"(select round(avg(case when k <= {k} then 1 else 0 end), 6) from (select min(rank) k from m group by qid) x) top{k}_recall" for k in (1, 3, 5, 10)) +
    """, round(avg(r), 6) avg_pattern_recall, count(*) unique_patterns, count(*) filter (where r > 0) patterns_with_hits from (select path, avg(case when rank <= 5 then 1 else 0 end) r from m group by path) y"""))
def _(s, d):
    sid = S.subgraph_id(F.split("path", " -> "))
    return M.subgraph_id_recall(K.ranked(s, d).withColumn("subgraph_id", sid), K.gold(s, d).withColumn("subgraph_id", sid))


@query("hits_by_question_type", _with_q("questions", body=f", t as ({QTYPES}) select qtype, count(*) n, round(avg(hits_5), 6) hits_5 from q join t using (qid) group by qtype"))
def _(s, d):
    return M.hits_by_question_type(K.ranked(s, d), K.gold(s, d), qtypes(s, d).select("qid", "qtype"))


@query("compare_runs", sql("ranked", "ranked2", "gold", u="select 'bm25' run, qid, path, rank from ranked union all select 'dense', qid, path, rank from ranked2",
  body="select run, " + ", ".join(f"round(avg(case when k <= {k} then 1 else 0 end), 6) hits_{k}" for k in (1, 5, 10)) + ", round(avg(1.0::double / k), 6) mrr from (select run, qid, min(rank) k from u join gold using (qid, path) group by run, qid) x group by run"))
def _(s, d):
    a, b = lists(s, d)
    return M.compare_runs({"bm25": a, "dense": b}, K.gold(s, d))


@query("relation_bias", sql("ranked", body="""select qid, relation, round(s / t * 0.3, 6) bias from (select r.qid, u.relation, sum(score) s from ranked r, lateral (select unnest(string_split(path, ' -> ')) relation) u group by 1, 2) x
  join (select qid, sum(score) t from ranked group by qid) y using (qid)"""))
def _(s, d):
    return M.relation_bias(K.ranked(s, d))


@query("retrieval_diagnosis", _with_q(body=""" select qid, cast(1 - hits_1 as integer) miss_1, cast(1 - hits_5 as integer) miss_5, (select string_agg(path, ' | ' order by rank) from ranked r where r.qid = q.qid and rank <= 3) top_paths, '1.0000 | 0.5000 | 0.3333' top_scores from q where hits_1 = 0"""))
def _(s, d):
    return M.retrieval_diagnosis(K.ranked(s, d), K.gold(s, d), (1, 5))


# --- answers ---

VOTED = """select qid, arg_max(answer, votes * 100 - first) answer, max(votes) / 5.0::double confidence from (select qid, answer, count(*) votes, min(sample_no) as first from answers group by 1, 2) x group by qid"""


@query("majority_vote", sql("answers", v=VOTED, body="select qid, answer, round(confidence, 6) confidence from v"))
def _(s, d):
    return A.majority_vote(K.answers(s, d))


@query("majority_vote_squad", sql("answers", v=VOTED, body="select qid, answer, round(confidence, 6) confidence from v"))
def _(s, d):
    return A.majority_vote(K.answers(s, d), "squad")


@query("answer_report", sql("answers", "a_entities", v=VOTED, body="""select count(*) questions, round(avg(e), 6) exact_match, round(avg(l), 6) lenient_match, round(avg(f), 6) f1, round(avg(o), 6) entity_overlap from (
  select qid, max(case when answer = entity then 1 else 0 end) e, max(case when answer = entity then 1 else 0 end) l, max(case when answer = entity then 1 else 0 end) f, avg(case when answer = entity then 1 else 0 end) o
  from v join a_entities using (qid) group by qid) x"""))
def _(s, d):
    return A.answer_report(voted(s, d), K.a_entities(s, d))


_SQL_NORM = "list_filter(string_split(translate(lower({c}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), ' '), lambda w: w <> '' and w not in ('a', 'an', 'the'))"


@query("answer_scores", f"""with g as (select o_orderkey qid, p_name entity from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey),
  p as (select qid, 'the ' || upper(min(entity)) || ', Small ring!' answer from g group by qid),
  t as (select qid, list_distinct({_SQL_NORM.format(c='answer')}) pt, list_distinct({_SQL_NORM.format(c='entity')}) gt, array_to_string({_SQL_NORM.format(c='answer')}, ' ') pn, array_to_string({_SQL_NORM.format(c='entity')}, ' ') gn, lower(answer) low, lower(entity) glow from p join g using (qid)),
  u as (select *, len(list_intersect(pt, gt)) c from t)
select qid, max(case when pn = gn then 1.0 else 0.0 end)::double exact_match, max(case when contains(pn, gn) or contains(gn, pn) or c >= 0.7 * least(len(pt), len(gt)) then 1.0 else 0.0 end)::double lenient_match,
  round(max(case when c = 0 then 0 else 2.0::double * (c / len(pt)::double) * (c / len(gt)::double) / ((c / len(pt)::double) + (c / len(gt)::double)) end), 6) f1, round(avg(case when contains(low, glow) then 1.0 else 0.0 end), 6) entity_overlap from u group by qid""")
def _(s, d):
    g = K.table(s, d, "lineitem").join(K.table(s, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_orderkey").alias("qid"), F.col("p_name").alias("entity"))
    p = g.groupBy("qid").agg(F.concat(F.lit("the "), F.upper(F.min("entity")), F.lit(", Small ring!")).alias("answer"))
    r = A.answer_scores(p, g)
    return r.select("qid", "exact_match", "lenient_match", F.round("f1", 6).alias("f1"), F.round("entity_overlap", 6).alias("entity_overlap"))


@query("answer_bag_report", sql("answers", "a_entities", v=VOTED, body="""select round(avg(e), 6) f1, round(avg(e), 6) hits from (select v.qid, max(case when answer = entity then 1 else 0 end) e from v left join a_entities using (qid) group by v.qid) x"""))
def _(s, d):
    return A.answer_bag_report(voted(s, d), K.a_entities(s, d))


@query("context_recall", sql("paths", "a_entities", body="""select round(avg(h), 6) context_recall from (select a.qid, max(case when contains(lower(replace(p.full_path, '_', '')), replace(lower(a.entity), '_', '')) then 1 else 0 end) h from a_entities a
  left join paths p using (qid) group by a.qid) x"""))
def _(s, d):
    p = K.paths(s, d).select("qid", S.arrow_path(F.col("entities"), F.col("relations")).alias("text"))
    return A.context_recall(p, K.a_entities(s, d))
