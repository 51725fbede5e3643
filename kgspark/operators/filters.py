"""Filters and projections over samples, triples, paths, entities and ranked lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from .numbering import top_per


def _filled(name: str) -> Column:
    return F.coalesce(F.size(name), F.lit(0)) > 0


def drop_without_paths(samples: DataFrame) -> DataFrame:
    return samples.filter(_filled("paths"))


def require_question_and_gold(samples: DataFrame) -> DataFrame:
    return samples.filter((F.coalesce("question", F.lit("")) != "") & _filled("paths"))


def clean_triples(samples: DataFrame, exact: bool = True) -> DataFrame:
    """``samples(id, graph array<array<string>>)`` → triples; lists that are not three long (or shorter) are dropped."""
    rows = samples.select(F.col("id").alias("gid"), F.posexplode("graph").alias("triple_idx", "t"))
    rows = rows.filter(F.size("t") == 3 if exact else F.size("t") >= 3)
    part = lambda i: F.get("t", F.lit(i)).cast("string")
    return rows.select("gid", "triple_idx", part(0).alias("subj"), part(1).alias("rel"), part(2).alias("obj"))


def is_machine_id(c: Column) -> Column:
    return c.startswith("m.") | c.startswith("g.")


def drop_machine_ids(entities: DataFrame) -> DataFrame:
    return entities.filter(~is_machine_id(F.col("entity")))


def drop_noise_entities(entities: DataFrame) -> DataFrame:
    """Short ``m.`` ids and texts over 100 characters go, unless a question would lose all it has."""
    e = F.col("entity")
    good = ~(e.startswith("m.") & (F.length(e) < 15)) & (F.length(e) <= 100)
    flagged = entities.withColumn("_good", good)
    some = flagged.groupBy("qid").agg(F.max("_good").alias("_some"))
    return flagged.join(some, "qid").filter(F.col("_good") | ~F.col("_some")).select(*entities.columns)


def max_path_length(paths: DataFrame, n: int = 5) -> DataFrame:
    return paths.filter(F.size("relations").between(1, n))


def min_score(ranked: DataFrame, threshold: float) -> DataFrame:
    return ranked.filter(F.col("score") >= threshold)


def filter_by_relations(ranked: DataFrame, relations: list[str]) -> DataFrame:
    return ranked.filter(F.arrays_overlap(F.split("path", " -> "), F.array(*[F.lit(r) for r in relations])))


def hops(path: Column) -> Column:
    return F.size(F.split(path, " -> "))


def hop_filter(ranked: DataFrame, qtypes: DataFrame, min_results: int = 3, strict: bool = False) -> DataFrame:
    """``qtypes(qid, min_hops, max_hops)``: keep paths of a fitting length; if too few fit, keep all (unless strict).

    Adds ``original_count``, ``filtered_count`` and ``applied``. Counting is an aggregate joined back, so a question
    with a huge list is never gathered in one task.
    """
    r = ranked.join(qtypes.select("qid", "min_hops", "max_hops"), "qid").withColumn(
        "_ok", hops(F.col("path")).between(F.col("min_hops"), F.col("max_hops")))
    n = r.groupBy("qid").agg(F.count(F.lit(1)).alias("original_count"), F.count_if("_ok").alias("_fit"))
    applied = F.lit(True) if strict else F.col("_fit") >= min_results
    out = r.join(n, "qid").withColumn("applied", applied)
    return out.filter(F.col("_ok") | ~F.col("applied")).withColumn(
        "filtered_count", F.when(F.col("applied"), F.col("_fit")).otherwise(F.col("original_count"))
    ).select(*ranked.columns, "original_count", "filtered_count", "applied")


def hop_filter_by_type(ranked: DataFrame, types: DataFrame) -> DataFrame:
    """``types(qid, qtype)``: keep paths within the hop range of the question type."""
    qtype = F.col("qtype")
    ok = F.lit(False)
    for name, (lo, hi) in C.HOP_RANGES.items():
        ok = ok | ((qtype == name) & hops(F.col("path")).between(lo, hi))
    return ranked.join(types.select("qid", "qtype"), "qid").filter(ok).select(*ranked.columns)


def hop_filter_confidence(ranked: DataFrame, qtypes: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Below the confidence threshold the range widens by one at each end; a question left empty keeps all."""
    sure = F.col("confidence") >= threshold
    lo = F.when(sure, F.col("min_hops")).otherwise(F.greatest(F.lit(1), F.col("min_hops") - 1))
    hi = F.when(sure, F.col("max_hops")).otherwise(F.col("max_hops") + 1)
    r = ranked.join(qtypes.select("qid", "confidence", "min_hops", "max_hops"), "qid").withColumn(
        "_ok", hops(F.col("path")).between(lo, hi))
    some = r.groupBy("qid").agg(F.max("_ok").alias("_some"))
    return r.join(some, "qid").filter(F.col("_ok") | ~F.col("_some")).select(*ranked.columns)


def min_pattern_frequency(patterns: DataFrame, n: int) -> DataFrame:
    return patterns.filter(F.col("example_count") >= n)


def limit_questions(questions: DataFrame, n: int) -> DataFrame:
    return questions.orderBy("qid").limit(n)


def seeded(seed: str | int, *cols: str) -> Column:
    """The hash that stands for chance: the same seed and keys give the same order everywhere."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def sample_questions(questions: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return questions.orderBy(seeded(seed, "qid"), "qid").limit(n)


def cap_list(rows: DataFrame, n: int, group: str = "qid", order: str = "pos") -> DataFrame:
    """The first n items of each list held as rows."""
    return top_per(rows, [group], [order], n, "_n").drop("_n")


def sample_summary(samples: DataFrame) -> DataFrame:
    return samples.select("id", "question", "answer", "q_entity", "a_entity",
                          F.coalesce(F.size("graph"), F.lit(0)).alias("graph_size"),
                          F.coalesce(F.size("paths"), F.lit(0)).alias("path_count"))


def is_compensated(samples: DataFrame) -> DataFrame:
    """Samples whose first path came without entities."""
    first = F.get(F.col("paths"), F.lit(0))
    return samples.filter(_filled("paths") & (F.coalesce(F.size(first["entities"]), F.lit(0)) == 0))
