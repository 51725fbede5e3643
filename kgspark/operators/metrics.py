"""Retrieval and entity metrics. Tables are joined on (qid, key) and reduced to one row per question, then averaged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import beside
from .numbering import first_per

KS = [1, 3, 5, 10, 20, 50, 100]
NORMS = {"path": S.norm_path, "lower": F.lower, "exact": lambda c: c}


def _best_ranks(ranked: DataFrame, gold: DataFrame, norm: str) -> DataFrame:
    """``(qid, key, rank)``: distinct gold keys with their best rank (null if never retrieved).

    The list is reduced to best ranks before the join, so a huge list costs one partial aggregate.
    """
    n = NORMS[norm]
    g = gold.select("qid", n(F.col("path")).alias("key")).distinct()
    r = ranked.select("qid", n(F.col("path")).alias("key"), "rank").groupBy("qid", "key").agg(F.min("rank").alias("rank"))
    return g.join(r, ["qid", "key"], "left")


def question_metrics(ranked: DataFrame, gold: DataFrame, ks: list[int] | None = None, norm: str = "path") -> DataFrame:
    """Per question with gold: ``recall_k`` and ``hits_k`` for every k, and ``rr``."""
    ks = ks or KS
    per = []
    for k in ks:
        found = F.count_if(F.col("rank") <= k)
        per += [(found / F.count(F.lit(1))).alias(f"recall_{k}"), (found > 0).cast("double").alias(f"hits_{k}")]
    rr = F.coalesce(F.lit(1.0) / F.min("rank"), F.lit(0.0)).alias("rr")
    return _best_ranks(ranked, gold, norm).groupBy("qid").agg(*per, rr)


def _summary(per_question: DataFrame, cols: list[str], questions: DataFrame | None) -> DataFrame:
    if questions is None:
        return per_question.agg(*[F.round(F.avg(c), 6).alias(c) for c in cols])
    joined = questions.select("qid").distinct().join(per_question, "qid", "left")
    return joined.agg(*[F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6).alias(c) for c in cols])


def recall_at_k(ranked, gold, ks=None, norm="path", questions=None) -> DataFrame:
    """Mean share of distinct gold paths among the top k. ``questions`` makes every question count."""
    ks = ks or KS
    return _summary(question_metrics(ranked, gold, ks, norm), [f"recall_{k}" for k in ks], questions)


def hits_at_k(ranked, gold, ks=None, norm="path", questions=None) -> DataFrame:
    ks = ks or KS
    return _summary(question_metrics(ranked, gold, ks, norm), [f"hits_{k}" for k in ks], questions)


def mrr(ranked, gold, norm="path", questions=None) -> DataFrame:
    return _summary(question_metrics(ranked, gold, [1], norm), ["rr"], questions).withColumnRenamed("rr", "mrr")


def retrieval_report(ranked, gold, ks=None, norm="path", questions=None) -> DataFrame:
    """Recall, hits and MRR in one pass."""
    ks = ks or KS
    cols = [f"recall_{k}" for k in ks] + [f"hits_{k}" for k in ks] + ["rr"]
    return _summary(question_metrics(ranked, gold, ks, norm), cols, questions)


def _relation_set(path: Column) -> Column:
    return F.array_distinct(F.split(path, S.SEP))


def _gold_share(pairs: DataFrame) -> DataFrame:
    """Adds ``overlap`` (share of the gold set that is predicted) and ``equal`` (same sets)."""
    common = F.size(F.array_intersect("p", "g"))
    return pairs.withColumn("overlap", common / F.size("g")).withColumn(
        "equal", (common == F.size("g")) & (common == F.size("p")))


def relation_hits_at_k(preds: DataFrame, gold: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Hit if a top-k prediction has the same relation set as a gold path or covers 80 % of it; all questions count."""
    p = preds.filter((F.col("rank") <= k) & (F.col("path") != "")).select("qid", _relation_set(F.col("path")).alias("p")).distinct()
    g = gold.select("qid", _relation_set(F.col("path")).alias("g")).distinct()
    hit = _gold_share(p.join(g, "qid")).groupBy("qid").agg(F.max(F.col("equal") | (F.col("overlap") >= 0.8)).cast("double").alias("hit"))
    return _summary(hit, ["hit"], questions).withColumnRenamed("hit", f"relation_hits_{k}")


def relation_recall(preds: DataFrame, gold: DataFrame, questions: DataFrame) -> DataFrame:
    """Exact, partial and mean best overlap of the first prediction.

    Gold paths are read in order up to the first exact one. A gold path before it with half its relations predicted
    counts as partial as well; an exact match makes the best overlap 1.
    """
    p = first_per(preds, ["qid"], ["rank"]).select("qid", _relation_set(F.col("path")).alias("p"))
    g = gold.select("qid", "path_no", _relation_set(F.col("path")).alias("g"))
    m = _gold_share(p.join(g, "qid"))
    per = m.groupBy("qid").agg(
        F.min(F.when(F.col("equal"), F.col("path_no"))).alias("exact_at"),
        F.min(F.when(~F.col("equal") & (F.col("overlap") >= 0.5), F.col("path_no"))).alias("partial_at"),
        F.max("overlap").alias("best"))
    exact = F.col("exact_at").isNotNull()
    partial = F.col("partial_at").isNotNull() & (~exact | (F.col("partial_at") < F.col("exact_at")))
    per = per.select("qid", exact.cast("double").alias("exact_recall"), partial.cast("double").alias("partial_recall"),
                     F.when(exact, F.lit(1.0)).otherwise(F.col("best")).alias("avg_relation_overlap"))
    return _summary(per, ["exact_recall", "partial_recall", "avg_relation_overlap"], questions)


def path_count_accuracy(counts: DataFrame) -> DataFrame:
    """``counts(qid, predicted, gold)``: right if equal, or if nothing was to be found and one path came."""
    right = (F.col("predicted") == F.col("gold")) | ((F.col("gold") == 0) & (F.col("predicted") == 1))
    return counts.agg(F.round(F.avg(right.cast("double")), 6).alias("path_count_accuracy"),
                      F.round(F.avg("predicted"), 6).alias("avg_predicted"), F.round(F.avg("gold"), 6).alias("avg_gold"))


def chain_accuracy(generated: DataFrame, gold: DataFrame) -> DataFrame:
    """``generated(qid, path)``: the first gold path that decides: same chain, or more than half its relations."""
    m = _gold_share(generated.select("qid", F.col("path").alias("chain"), _relation_set(F.col("path")).alias("p")).join(
        gold.select("qid", "path_no", F.col("path").alias("gold_chain"), _relation_set(F.col("path")).alias("g")), "qid"))
    verdict = F.when(F.col("chain") == F.col("gold_chain"), F.lit("exact")).when(F.col("overlap") > 0.5, F.lit("partial"))
    first = m.withColumn("verdict", verdict).filter(F.col("verdict").isNotNull()).groupBy("qid").agg(F.min_by("verdict", "path_no").alias("verdict"))
    per = gold.select("qid").distinct().join(first, "qid", "left")
    share = lambda v, n: F.round(F.avg((F.coalesce("verdict", F.lit("")) == v).cast("double")), 6).alias(n)
    return per.agg(F.count(F.lit(1)).alias("with_gold"), share("exact", "relation_chain_accuracy"), share("partial", "partial_relation_match"))


def entity_hits_at_k(retrieved: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """``retrieved(qid, entity)`` in text order; questions with gold count."""
    from .numbering import top_per

    top = top_per(retrieved.select("qid", "entity").distinct(), ["qid"], ["entity"], k).select("qid", F.lower("entity").alias("low")).distinct()
    g = gold.select("qid", F.lower("entity").alias("low")).distinct()
    hit = g.join(top.withColumn("ok", F.lit(1)), ["qid", "low"], "left").groupBy("qid").agg(F.max(F.coalesce("ok", F.lit(0))).alias("ok"))
    return hit.agg(F.round(F.avg("ok"), 6).alias(f"entity_hits_{k}"))


def question_entity_overlap(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """Per question with gold: sizes of both sides and of the common part, ignoring case."""
    r = retrieved.select("qid", F.lower("entity").alias("low"), F.lit(1).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("n"))
    g = gold.select("qid", "entity").distinct().select("qid", F.lower("entity").alias("low"), F.lit(0).alias("r"), F.lit(1).alias("g"), F.lit(1).alias("n"))
    both = r.unionByName(g).groupBy("qid", "low").agg(F.max("r").alias("r"), F.max("g").alias("g"), F.sum("n").alias("n"))
    per = both.groupBy("qid").agg(F.sum("r").alias("retrieved"), F.sum("g").alias("gold"), F.sum(F.col("r") * F.col("g")).alias("common"),
                                  F.sum("n").alias("gold_names"))
    return per.filter(F.col("gold") > 0)


def entity_recall(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """Micro recall, share of questions with exactly the gold set, share with a part of it."""
    per = question_entity_overlap(retrieved, gold)
    exact = (F.col("common") == F.col("gold")) & (F.col("common") == F.col("retrieved"))
    return per.agg(F.round(F.sum("common") / F.sum("gold_names"), 6).alias("entity_recall"),
                   F.round(F.avg(exact.cast("double")), 6).alias("exact_match_rate"),
                   F.round(F.avg((~exact & (F.col("common") > 0)).cast("double")), 6).alias("partial_match_rate"),
                   F.count(F.lit(1)).alias("total_samples"))


def candidate_recall(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Share of questions with an answer whose normal form is among the candidates ``(qid, entity)``."""
    n = S.norm_answer(F.col("entity"))
    c = candidates.select("qid", n.alias("key")).distinct().withColumn("ok", F.lit(1.0))
    per = answers.select("qid", n.alias("key")).distinct().join(beside(c), ["qid", "key"], "left").groupBy("qid").agg(F.max(F.coalesce("ok", F.lit(0.0))).alias("ok"))
    return per.agg(F.round(F.avg("ok"), 6).alias("candidate_recall"))


def source_contribution(reranked: DataFrame, retrieved: DataFrame, generated: DataFrame) -> DataFrame:
    """Mean share of re-ranked paths that came from either list."""
    key = lambda df: df.select("qid", S.norm_path(F.col("path")).alias("key"))
    rows = key(reranked)
    for name, side in (("a", retrieved), ("b", generated)):
        rows = rows.join(key(side).distinct().withColumn(name, F.lit(1.0)), ["qid", "key"], "left")
    per = rows.groupBy("qid").agg(F.avg(F.coalesce("a", F.lit(0.0))).alias("a"), F.avg(F.coalesce("b", F.lit(0.0))).alias("b"))
    return per.agg(F.round(F.avg("a"), 6).alias("from_retrieval"), F.round(F.avg("b"), 6).alias("from_generation"))


def subgraph_id_recall(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """``preds(qid, rank, subgraph_id)``, ``gold(qid, subgraph_id)``: top-k recall and recall per pattern at 5."""
    g = gold.select("qid", "subgraph_id").distinct().join(preds.select("qid").distinct(), "qid", "left_semi")
    p = preds.groupBy("qid", "subgraph_id").agg(F.min("rank").alias("rank"))
    m = g.join(p, ["qid", "subgraph_id"], "left")
    per_q = m.groupBy("qid").agg(F.min("rank").alias("rank"))
    top = per_q.agg(F.count(F.lit(1)).alias("total_with_gold"), *[
        F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 6).alias(f"top{k}_recall") for k in (1, 3, 5, 10)])
    per_p = m.groupBy("subgraph_id").agg(F.avg(F.coalesce((F.col("rank") <= 5).cast("double"), F.lit(0.0))).alias("r"))
    pat = per_p.agg(F.struct(F.round(F.avg("r"), 6).alias("a"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("r") > 0).alias("h"))).scalar()
    return top.withColumn("_p", pat).select("total_with_gold", *[f"top{k}_recall" for k in (1, 3, 5, 10)], F.col("_p.a").alias("avg_pattern_recall"),
                                            F.col("_p.n").alias("unique_patterns"), F.col("_p.h").alias("patterns_with_hits"))


def hits_by_question_type(ranked: DataFrame, gold: DataFrame, types: DataFrame, k: int = 5, norm: str = "exact") -> DataFrame:
    per = question_metrics(ranked, gold, [k], norm)
    return types.join(per, "qid").groupBy("qtype").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(f"hits_{k}"), 6).alias(f"hits_{k}"))


def compare_runs(runs: dict[str, DataFrame], gold: DataFrame, ks: list[int] | None = None, norm: str = "lower") -> DataFrame:
    """One row per named run. The runs are one table with a run column, reduced in one pass."""
    ks = ks or [1, 5, 10]
    rows = None
    for name, r in runs.items():
        one = r.select(F.lit(name).alias("run"), "qid", NORMS[norm](F.col("path")).alias("key"), "rank")
        rows = one if rows is None else rows.unionByName(one)
    g = gold.select("qid", NORMS[norm](F.col("path")).alias("key")).distinct()
    best = rows.join(g, ["qid", "key"], "left_semi").groupBy("run", "qid").agg(F.min("rank").alias("rank"))
    total = g.select(F.count_distinct("qid").cast("double")).scalar()
    found = best.groupBy("run").agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks], F.sum(F.lit(1.0) / F.col("rank")).alias("rr"))
    # a run without any hit has its row too
    out = rows.select("run").distinct().join(found, "run", "left").fillna(0)
    return out.select("run", *[F.round(F.col(f"h{k}") / total, 6).alias(f"hits_{k}") for k in ks], F.round(F.col("rr") / total, 6).alias("mrr"))


def relation_bias(ranked: DataFrame, weight: float = 0.3) -> DataFrame:
    """Per question and relation: summed score of paths that hold it (per occurrence) over the total score, times weight."""
    total = ranked.groupBy("qid").agg(F.sum("score").alias("total"))
    per = ranked.select("qid", "score", F.explode(F.split("path", S.SEP)).alias("relation")).groupBy("qid", "relation").agg(F.sum("score").alias("s"))
    return per.join(total, "qid").select("qid", "relation", F.round(F.when(F.col("total") != 0, F.col("s") / F.col("total") * weight), 6).alias("bias"))


def retrieval_diagnosis(ranked: DataFrame, gold: DataFrame, ks: tuple[int, int] = (1, 10), norm: str = "exact") -> DataFrame:
    """Questions whose gold paths miss the first cut, with their first three paths and the two miss flags."""
    per = question_metrics(ranked, gold, list(ks), norm)
    miss = per.filter(F.col(f"hits_{ks[0]}") == 0).select("qid", *[(1 - F.col(f"hits_{k}")).cast("int").alias(f"miss_{k}") for k in ks])
    top = ranked.filter(F.col("rank") <= 3).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "score"))).alias("t"))
    return miss.join(top, "qid", "left").select(
        "qid", *[f"miss_{k}" for k in ks], F.array_join(F.transform("t", lambda x: x["path"]), " | ").alias("top_paths"),
        F.array_join(F.transform("t", lambda x: F.format_number(x["score"], 4)), " | ").alias("top_scores"))


def extraction_coverage(per_path: DataFrame, ranked: DataFrame, answers: DataFrame) -> DataFrame:
    """``per_path(qid, rank, entity)`` found along ``ranked(qid, rank)``: paths with entities, questions with an answer found."""
    got = per_path.select("qid", "rank").distinct().withColumn("ok", F.lit(1))
    paths = ranked.select("qid", "rank").join(beside(got), ["qid", "rank"], "left").agg(
        F.count(F.lit(1)).alias("paths"), F.sum(F.coalesce("ok", F.lit(0))).alias("paths_with_entities"))
    low = lambda df: df.select("qid", F.lower("entity").alias("low")).distinct()
    found = low(answers).join(beside(low(per_path)), ["qid", "low"], "left_semi").select(F.count_distinct("qid")).scalar()
    asked = answers.select(F.count_distinct("qid")).scalar()
    return paths.select("paths", "paths_with_entities", asked.alias("questions"), found.alias("questions_with_answer"))
