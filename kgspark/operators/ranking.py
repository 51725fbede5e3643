"""Ranked lists: top-k, fusion, blending, boosting, dedupe, promotion.

A ranked list is rows of ``(qid, source, rank, score, path_id, path)``. Per-question minima, maxima and counts are
aggregates joined back (never a window over the whole list), and every cut to k runs before the shuffle as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import beside, cut_lineage
from .numbering import first_per, top_per


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """Best k per question, ties by path id, ranks from 1."""
    return top_per(scored, ["qid"], [F.col("score").desc(), F.col("path_id")], k)


def rerank(ranked: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """``scores(qid, path_id, score)`` replace the old ones; a path without one stands behind all others."""
    cols = ranked.columns
    return top_k(ranked.drop("score", "rank").join(scores.select("qid", "path_id", "score"), ["qid", "path_id"], "left"), k).select(*cols)


def _known(frequency: DataFrame) -> DataFrame:
    """One row per path, written out: its size, not that of the lists it was counted from, then decides how it meets the lists."""
    return cut_lineage(frequency)


def _bounds(df: DataFrame, *cols: str) -> DataFrame:
    aggs = [f(c).alias(f"_{n}_{c}") for c in cols for f, n in ((F.min, "lo"), (F.max, "hi"))]
    return df.groupBy("qid").agg(*aggs)


def _unit(c: str) -> Column:
    """Min-max to 0…1; a flat list is divided by 1 and so becomes 0."""
    lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
    return (F.col(c) - lo) / F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))


def rrf_fuse(lists: list[DataFrame], top: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion; ties keep the order of the first list, then of the next."""
    rows = None
    for i, one in enumerate(lists):
        r = one.select("qid", "path_id", F.lit(i).alias("_list"), "rank")
        rows = r if rows is None else rows.unionByName(r)
    ranks = [F.min(F.when(F.col("_list") == i, F.col("rank"))).alias(f"_r{i}") for i in range(len(lists))]
    fused = rows.groupBy("qid", "path_id").agg(F.sum(F.lit(1.0) / (F.col("rank") + k)).alias("score"), *ranks)
    fused = fused.withColumn("score", F.round("score", 12))
    order = [F.col("score").desc(), *[F.col(f"_r{i}").asc_nulls_last() for i in range(len(lists))], F.col("path_id")]
    return top_per(fused, ["qid"], order, top).select("qid", "rank", "score", "path_id")


def minmax_fuse(bm25: DataFrame, dense: DataFrame, top: int, alpha: float = 0.5) -> DataFrame:
    """Weighted sum of the two lists scaled to 0…1; ``alpha`` weighs the dense one; a missing score counts 0."""
    both = bm25.select("qid", "path_id", "score", F.lit("b").alias("_src")).unionByName(
        dense.select("qid", "path_id", "score", F.lit("d").alias("_src")))
    lim = both.groupBy("qid", "_src").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    unit = F.when(span < 1e-9, F.lit(1.0)).otherwise((F.col("score") - F.col("_lo")) / span)
    weight = F.when(F.col("_src") == "d", F.lit(alpha)).otherwise(F.lit(1 - alpha))
    fused = both.join(lim, ["qid", "_src"]).groupBy("qid", "path_id").agg(F.sum(weight * unit).alias("score"))
    return top_k(fused.withColumn("score", F.round("score", 12)), top).select("qid", "rank", "score", "path_id")


def fuse_full_corpus(dense_top: DataFrame, bm25_all: DataFrame, top: int, variant: str = "minmax", dense_weight: float | None = None,
                     corpus_size: int | None = None) -> DataFrame:
    """BM25 over everything with dense scores only for the dense top list.

    ``bm25_all`` may hold the matches only: with ``corpus_size``, a question with fewer rows has paths of score 0, which count
    in the minimum. ``minmax``: both scaled with 1e-9 added to the range, weight 0.5. ``scaled``: raw dense 0.7 + BM25 / maximum 0.3.
    """
    w = dense_weight if dense_weight is not None else (0.5 if variant == "minmax" else 0.7)
    lim = lambda df, p: df.groupBy("qid").agg(F.min("score").alias(f"{p}lo"), F.max("score").alias(f"{p}hi"), F.count(F.lit(1)).alias(f"{p}n"))
    b = bm25_all.select("qid", "path_id", "score").join(lim(bm25_all, "b"), "qid")
    if corpus_size is not None:
        partial = F.col("bn") < corpus_size
        b = b.withColumns({"blo": F.when(partial, F.least("blo", F.lit(0.0))).otherwise(F.col("blo")), "bhi": F.when(partial, F.greatest("bhi", F.lit(0.0))).otherwise(F.col("bhi"))})
    d = dense_top.select("qid", "path_id", "score").join(lim(dense_top, "d"), "qid")
    if variant == "minmax":
        bs = (F.col("score") - F.col("blo")) / (F.col("bhi") - F.col("blo") + 1e-9)
        ds = (F.col("score") - F.col("dlo")) / (F.col("dhi") - F.col("dlo") + 1e-9)
    else:
        bs = F.col("score") / F.when(F.col("bhi") > 0, F.col("bhi")).otherwise(F.lit(1.0))
        ds = F.col("score")
    rows = b.select("qid", "path_id", ((1 - w) * bs).alias("part")).unionByName(d.select("qid", "path_id", (w * ds).alias("part")))
    fused = rows.groupBy("qid", "path_id").agg(F.round(F.sum("part"), 12).alias("score"))
    return top_k(fused, top).select("qid", "rank", "score", "path_id")


def fuse_two_views(a: DataFrame, b: DataFrame, top: int, wa: float = 0.5, wb: float = 0.5, absent: float = -100.0) -> DataFrame:
    """Weighted sum of two score sets over the corpus."""
    one = lambda df, n: df.select("qid", "path_id", F.col("score").alias(n))
    both = one(a, "sa").join(one(b, "sb"), ["qid", "path_id"], "full")
    s = wa * F.coalesce("sa", F.lit(absent)) + wb * F.coalesce("sb", F.lit(absent))
    return top_k(both.select("qid", "path_id", F.round(s, 12).alias("score")), top).select("qid", "rank", "score", "path_id")


def blend_scores(ranked: DataFrame, extra: DataFrame, k: int, weight: float = 0.3) -> DataFrame:
    """(1-w) · retrieval score + w · extra score scaled to 0…1. ``extra(qid, path_id, extra)``; a path without one counts as the lowest."""
    r = ranked.join(beside(extra.select("qid", "path_id", "extra")), ["qid", "path_id"], "left")
    s = (1 - weight) * F.col("score") + weight * F.coalesce(_unit("extra"), F.lit(0.0))
    return top_k(r.join(beside(_bounds(r, "extra")), "qid").withColumn("score", F.round(s, 12)), k).select(*ranked.columns)


def ensemble_rank(ranked: DataFrame, extra: DataFrame, frequency: DataFrame, k: int,
                  weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """Weighted sum of retrieval score, extra score and path frequency, each scaled to 0…1; what a path lacks counts as the lowest."""
    r = ranked.join(beside(extra.select("qid", "path_id", "extra")), ["qid", "path_id"], "left").join(
        _known(frequency.select("path_id", F.col("frequency").cast("double").alias("frequency"))), "path_id", "left")
    s = weights[0] * _unit("score") + weights[1] * F.coalesce(_unit("extra"), F.lit(0.0)) + weights[2] * F.coalesce(_unit("frequency"), F.lit(0.0))
    return top_k(r.join(beside(_bounds(r, "score", "extra", "frequency")), "qid").withColumn("score", F.round(s, 12)), k).select(*ranked.columns)


def frequency_boost(ranked: DataFrame, frequency: DataFrame, k: int) -> DataFrame:
    s = F.col("score") + F.coalesce(F.least(F.lit(0.1), F.col("frequency") / 1000), F.lit(0.0))  # least() passes over nulls
    s = F.when(F.col("frequency").isNull(), F.col("score")).otherwise(s)
    return top_k(ranked.join(_known(frequency), "path_id", "left").withColumn("score", F.round(s, 12)), k).select(*ranked.columns)


def keyword_boost(ranked: DataFrame, keywords: DataFrame, k: int) -> DataFrame:
    """Among the best 2k, each ``keywords(qid, words)`` entry found in the path adds 0.1."""
    pool = top_k(ranked, 2 * k).join(keywords.select("qid", "words"), "qid", "left")
    given = F.coalesce("words", F.array().cast("array<string>"))
    hits = S.let(F.lower("path"), lambda low: F.size(F.filter(given, lambda w: F.contains(low, F.lower(w)))))
    return top_k(pool.withColumn("score", F.round(F.col("score") + 0.1 * hits, 12)), k).select(*ranked.columns)


def jaccard_rank(paths: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Share of relations a path has in common with ``wanted(qid, relations)``."""
    r = paths.join(wanted.select("qid", F.array_distinct("relations").alias("_w")), "qid").withColumn("_p", F.array_distinct(S.split_chain(F.col("path"))))
    union = F.size(F.array_union("_p", "_w"))
    s = F.when(union > 0, F.size(F.array_intersect("_p", "_w")) / union).otherwise(F.lit(0.0))
    return top_k(r.withColumn("score", s), k).select("qid", "rank", "score", "path_id", "path")


def ordered_dedupe(rows: DataFrame, key: Column, order: list[str], group: str = "qid") -> DataFrame:
    """Keep the first row per key; rows keep their old position columns."""
    kept = first_per(rows.withColumn("_key", key), [group, "_key"], order)
    return kept.select(*rows.columns)


def combine_paths(first: DataFrame, second: DataFrame, limit: int | None = None, dedupe: bool = True) -> DataFrame:
    """First list, then second, without repeats (trimmed, lower case), up to ``limit``. Adds ``pos`` when limited."""
    rows = first.withColumn("_list", F.lit(0)).unionByName(second.withColumn("_list", F.lit(1)))
    if dedupe:
        rows = ordered_dedupe(rows, F.lower(S.strip(F.col("path"))), ["_list", "rank"])
    if limit is None:
        return rows.withColumnRenamed("_list", "list_no")
    return top_per(rows, ["qid"], ["_list", "rank"], limit, "pos").withColumnRenamed("_list", "list_no")


def union_retrieval(question_list: DataFrame, second_list: DataFrame, cap: int) -> DataFrame:
    return combine_paths(question_list, second_list, cap)


def match_rank(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """First rank at which a gold path stands, and whether it is the top or among the top five."""
    gold_low = gold.select("qid", F.lower("path").alias("low")).distinct()
    hit = ranked.withColumn("low", F.lower("path")).join(gold_low, ["qid", "low"], "left_semi").groupBy("qid").agg(F.min("rank").alias("first_rank"))
    return ranked.select("qid").distinct().join(hit, "qid", "left").select(
        "qid", "first_rank", F.coalesce(F.col("first_rank") == 1, F.lit(False)).alias("top1"),
        F.coalesce(F.col("first_rank") <= 5, F.lit(False)).alias("top5"))


def promote_match(ranked: DataFrame, gold: DataFrame, within: int = 5, keep: int = 3) -> DataFrame:
    """Analysis only, it looks at gold: the first match within the top five, then the rest of the top three."""
    m = match_rank(ranked, gold).filter(F.col("first_rank") <= within).select("qid", "first_rank")
    r = ranked.filter(F.col("rank") <= max(within, keep)).join(m, "qid", "left")
    is_match = F.coalesce(F.col("rank") == F.col("first_rank"), F.lit(False))
    r = r.withColumn("is_match", is_match).filter(F.col("is_match") | (F.col("rank") <= keep))
    return top_per(r, ["qid"], [F.col("is_match").desc(), F.col("rank")], keep + 1, "pos").drop("first_rank")


def score_generated(generated: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Score ``generated(qid, pos, relations)`` by overlap with ``retrieved(qid, path, score)`` and by repetition.

    The overlap is summed over (relation) equi-joins. Repeats are counted from the distinct lists and sets of a
    question: equal lists before this one, and equal sets before this one that are not equal lists.
    """
    rel = lambda df, c: df.withColumn("_rel", F.explode(F.array_distinct(c)))
    # sum over retrieved of |overlap| * score = sum over shared relations of the total score of paths that hold them
    weight = rel(retrieved.select("qid", "score", S.split_chain(F.col("path")).alias("r")), F.col("r")).groupBy("qid", "_rel").agg(F.sum("score").alias("w"))
    bonus = rel(generated.select("qid", "pos", "relations"), F.col("relations")).join(weight, ["qid", "_rel"]).groupBy("qid", "pos").agg(F.sum("w").alias("bonus"))
    g = generated.withColumn("_set", F.array_sort(F.array_distinct("relations")))
    from pyspark.sql import Window as W
    same_list = F.row_number().over(W.partitionBy("qid", "relations").orderBy("pos")) - 1
    same_set = F.row_number().over(W.partitionBy("qid", "_set").orderBy("pos")) - 1
    g = g.withColumn("_lists", same_list).withColumn("_sets", same_set).join(bonus, ["qid", "pos"], "left")
    s = 1.0 + 0.1 * F.coalesce("bonus", F.lit(0.0)) - 0.5 * F.col("_lists") - 0.2 * (F.col("_sets") - F.col("_lists"))
    return g.select(*generated.columns, F.round(F.greatest(F.lit(0.1), s * S.unique_ratio(F.col("relations"))), 12).alias("score"))


def blend_fixed_range(ranked: DataFrame, extra: DataFrame, k: int, weight: float = 0.3) -> DataFrame:
    """(1-w) · score + w · (extra + 10) / 10; an extra score that is no finite number counts -10."""
    x = F.col("extra")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    s = (1 - weight) * F.col("score") + weight * (F.when(finite, x).otherwise(F.lit(-10.0)) + 10) / 10
    r = ranked.join(extra.select("qid", "path_id", "extra"), ["qid", "path_id"], "left")
    return top_k(r.withColumn("score", F.round(s, 12)), k).select(*ranked.columns)


def promote_picks(ranked: DataFrame, picks: DataFrame, n: int = 5, pool: int | None = None) -> DataFrame:
    """``picks(qid, picks array<int>)`` of 1-based ranks first (out of range ignored), then the old order, n in all."""
    r = (ranked if pool is None else ranked.filter(F.col("rank") <= pool)).join(picks.select("qid", "picks"), "qid", "left")
    at = F.array_position(F.coalesce("picks", F.array().cast("array<int>")), F.col("rank"))
    r = r.withColumn("_at", F.when(at > 0, at))
    return top_per(r, ["qid"], [F.col("_at").asc_nulls_last(), F.col("rank")], n, "pos").drop("picks", "_at")


def promote_single_pick(ranked: DataFrame, picks: DataFrame, pool: int | None = None) -> DataFrame:
    """One path per question: the picked rank, or rank 1 if the pick is missing or out of range."""
    r = (ranked if pool is None else ranked.filter(F.col("rank") <= pool)).join(picks.select("qid", "pick"), "qid", "left")
    return first_per(r, ["qid"], [F.coalesce(F.col("rank") != F.col("pick"), F.lit(True)), F.col("rank")]).drop("pick")


def cap_paths_per_target(paths: DataFrame, order: list[str], per_target: int | None = None, total: int | None = None) -> DataFrame:
    from .path_search import select_paths

    return select_paths(paths, order, per_target, total)


def diverse_paths(paths: DataFrame, order: list[str], limit: int | None = None, seed: int | None = None) -> DataFrame:
    """Shortest path per distinct last entity, then the shortest ``limit``. With a seed, one of the three shortest."""
    hops, target = F.size("relations"), F.element_at("entities", -1)
    r = paths.filter(F.size("entities") > 0).withColumn("_hops", hops).withColumn("_target", target)
    if seed is not None:
        r = top_per(r, ["qid", "_target"], ["_hops", *order], 3, "_k")
        chance = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("qid").cast("string"), F.col("_target"), F.col("_k").cast("string")))
        r = first_per(r.withColumn("_c", chance), ["qid", "_target"], ["_c"]).drop("_c", "_k")
    else:
        r = first_per(r, ["qid", "_target"], ["_hops", *order])
    return top_per(r, ["qid"], ["_hops", *order], limit, "no").drop("_hops", "_target")


def shortest_covering_paths(paths: DataFrame, answers: DataFrame) -> DataFrame:
    """``paths(qid, path_no, entities, relations, full_path, relation_chain)``, ``answers(qid, entity)`` → minimal labels.

    Per answer the shortest path that ends in it (trimmed, lower case). An answer without one takes the shortest path of
    the first target that holds it or is held by it. One row per path text; ``via`` orders the answers.

    A question's answers meet its targets where they lie, each with each; only for questions with too many such pairs grams are made.
    """
    from .grams import containment_pairs, crowded, split_groups

    p = paths.withColumn("_hops", F.size("relations")).withColumn(
        "target", S.norm_entity(S.path_target(F.col("entities"), F.col("full_path")))).filter(F.col("target") != "")
    # the best path of each target, and where that target first appears
    best = p.groupBy("qid", "target").agg(F.min("path_no").alias("seen"), F.min_by(
        F.struct("path_no", "entities", "relations", "full_path", "relation_chain"), F.struct("_hops", "path_no")).alias("_path"))
    norm = answers.select("qid", S.norm_entity(F.col("entity")).alias("norm"), "entity").groupBy("qid", "norm").agg(F.min("entity").alias("entity"))
    many = crowded(paths, answers, ["qid"])
    (few_best, many_best), (few_norm, many_norm) = split_groups(best, many, ["qid"]), split_groups(norm, many, ["qid"])
    cover = few_norm.join(beside(few_best), "qid").filter(F.contains("target", F.col("norm")) | F.contains("norm", F.col("target")))
    if many is not None:  # equal texts hold each other, so both ways find them; the better of equal rows is taken below
        for pairs in (containment_pairs(many_best, many_norm, ["qid"], "target", "norm"), containment_pairs(many_norm, many_best, ["qid"], "norm", "target")):
            cover = cover.unionByName(pairs.select(*cover.columns))
    found = first_per(cover.withColumn("late", (F.col("norm") != F.col("target")).cast("int")), ["qid", "norm"], ["late", "seen"])
    rows = found.select("qid", "late", "entity", "_path.*")
    key = F.when(F.coalesce("full_path", F.lit("")) != "", F.col("full_path")).otherwise(F.col("relation_chain"))
    return ordered_dedupe(rows, key, ["late", "entity"]).withColumnRenamed("entity", "via").drop("late")
