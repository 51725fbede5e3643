"""Counts and averages over samples, triples, lists and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .filters import hops


def hop_histogram(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy(hops(F.col("path")).alias("hops")).agg(F.count(F.lit(1)).alias("n"))


def hop_summary(ranked: DataFrame) -> DataFrame:
    h = hops(F.col("path"))
    return ranked.agg(F.min(h).alias("min_hops"), F.max(h).alias("max_hops"), F.round(F.avg(h), 6).alias("avg_hops"))


def _n(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def path_coverage_stats(samples: DataFrame) -> DataFrame:
    """Samples, samples with paths, paths in all and per sample, graph size, and the same for the minimal labels."""
    aggs = [F.count(F.lit(1)).alias("samples"), F.count_if(_n("paths") > 0).alias("with_paths"), F.sum(_n("paths")).alias("total_paths"),
            F.round(F.avg(_n("paths")), 6).alias("avg_paths"), F.round(F.avg(_n("graph")), 6).alias("avg_graph_size")]
    if "shortest_gt_paths" in samples.columns:
        aggs += [F.count_if(_n("shortest_gt_paths") > 0).alias("with_shortest"), F.sum(_n("shortest_gt_paths")).alias("total_shortest")]
    return samples.agg(*aggs)


def missing_path_reasons(samples: DataFrame, labelled: str = "shortest_gt_paths") -> DataFrame:
    """Why samples have no minimal label: the first reason that applies."""
    reason = F.when(_n("a_entity") == 0, "no_answer_entity").when(_n("q_entity") == 0, "no_question_entity").when(
        _n("graph") == 0, "no_graph").when(_n("paths") == 0, "no_paths").otherwise("no_match")
    return samples.filter(_n(labelled) == 0).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def graph_stats(triples: DataFrame) -> DataFrame:
    """Triples, entities and relations. Entities are counted over both ends in one distinct aggregate."""
    entities = triples.select(F.explode(F.array("subj", "obj")).alias("e")).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    relations = triples.select("rel").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return triples.agg(F.count(F.lit(1)).alias("triples")).select("triples", entities.alias("entities"), relations.alias("relations"))


def stage_timing(results: DataFrame, stages: list[str]) -> DataFrame:
    """Mean milliseconds per stage, their sum, and questions per second."""
    total = sum((F.avg(s) for s in stages[1:]), F.avg(stages[0]))
    return results.agg(*[F.round(F.avg(s), 6).alias(s) for s in stages], F.round(total, 6).alias("total_ms"),
                       F.round(F.when(total > 0, 1000.0 / total).otherwise(F.lit(0.0)), 6).alias("questions_per_second"))


def class_weights(labels: DataFrame, col: str, classes: int | None = None) -> DataFrame:
    """``(label, n, weight)`` with weight = total / (classes * n + 1)."""
    counts = labels.groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = labels.agg(F.count(F.lit(1)).alias("t")).scalar()
    size = F.lit(classes) if classes else labels.select(F.count_distinct(col)).scalar()
    return counts.select("label", "n", F.round(total / (size * F.col("n") + 1), 6).alias("weight"))


def triplet_accuracy(triplets: DataFrame) -> DataFrame:
    """``triplets(anchor, positive, negative)`` of vectors: share with the positive closer than the negative."""
    return triplets.agg(F.round(F.avg((dot(F.col("anchor"), F.col("positive")) > dot(F.col("anchor"), F.col("negative"))).cast("double")), 6).alias("triplet_accuracy"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def question_path_length_stats(samples: DataFrame) -> DataFrame:
    """Mean words per question, mean parts per path (averaged per sample first), samples with several answers."""
    per = F.when(_n("paths") > 0, F.aggregate(F.transform("paths", lambda p: F.size(F.split(p["relation_chain"], S.SEP)).cast("double")),
                                              F.lit(0.0), lambda a, x: a + x) / F.size("paths"))
    return samples.agg(F.round(F.avg(F.size(S.words(F.col("question")))), 6).alias("avg_question_words"), F.round(F.avg(per), 6).alias("avg_path_parts"),
                       F.count_if(_n("a_entity") > 1).alias("multi_answer"))
