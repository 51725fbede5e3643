"""Joins between sample tables, set operations and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import seeded
from .numbering import first_per, positions


def last_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key, as a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def join_graph_with_labels(graphs: DataFrame, labels: DataFrame, order: list[str], keep: str = "last") -> DataFrame:
    """Graph from one side, everything else from the other; one row per id on each side (the last, or the first)."""
    pick = last_per if keep == "last" else first_per
    g = pick(graphs.select("id", "graph", *[o for o in order if o != "id"]), ["id"], order).select("id", "graph")
    l = pick(labels.drop("graph"), ["id"], order)
    if dict(l.dtypes).get("answer") == "string":
        l = l.withColumn("answer", F.array("answer"))
    return l.join(g, "id")


def attach_paths(samples: DataFrame, paths: DataFrame) -> DataFrame:
    """Left lookup of ``paths(id, paths)``; a missing list becomes an empty one."""
    kind = dict(paths.dtypes)["paths"]
    return samples.drop("paths").join(paths.select("id", "paths"), "id", "left").withColumn("paths", F.coalesce("paths", F.array().cast(kind)))


def lookup_by_question(preds: DataFrame, samples: DataFrame, order: list[str]) -> DataFrame:
    """Samples by question text; the last sample with a text counts."""
    return preds.join(last_per(samples, ["question"], order), "question", "left")


def found_elsewhere(empty: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    return empty.join(other.select(key), key, "left_semi")


def without_match(df: DataFrame, other: DataFrame, key: str = "id") -> DataFrame:
    return df.join(other.select(key), key, "left_anti")


def positional_join(df: DataFrame, values: DataFrame, df_order: list[str], value_order: list[str]) -> DataFrame:
    """Row i of one table takes row i of the other; different lengths are refused. Prefer a real key where one exists."""
    a, b = df.count(), values.count()
    if a != b:
        raise ValueError(f"{a} rows cannot take {b} values one by one")
    left = positions(df, df_order, name="_row")
    right = positions(values, value_order, name="_row").drop(*[c for c in value_order if c in df.columns])
    return left.join(right, "_row").drop("_row")


def corpus_membership(gold: DataFrame, corpus: DataFrame) -> DataFrame:
    """First gold path of each question that the corpus holds."""
    known = gold.join(corpus.select("path").distinct(), "path", "left_semi")
    return first_per(known.select("qid", "path_no", "path"), ["qid"], ["path_no"])


def corpus_coverage(gold: DataFrame, corpus: DataFrame) -> DataFrame:
    covered = corpus_membership(gold, corpus).agg(F.count(F.lit(1)).alias("n")).scalar()
    return gold.agg(F.count_distinct("qid").alias("questions")).select("questions", covered.alias("covered"))


def concatenate(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def distinct_union(*parts: DataFrame) -> DataFrame:
    return concatenate(*parts).distinct()


def common_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), keys, "left_semi")


def rows_without(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def train_val_split(samples: DataFrame, ratio: float = 0.1, seed: int = 42, key: str = "id") -> DataFrame:
    """Adds ``split``: the first int(n * ratio) rows in seeded order are ``val``."""
    n = samples.agg(F.floor(F.count(F.lit(1)) * ratio).alias("n")).scalar()
    rows = positions(samples.withColumn("_h", seeded(seed, key)), ["_h", key], name="_row")
    return rows.withColumn("split", F.when(F.col("_row") < n, "val").otherwise("train")).drop("_row", "_h")


def stratified_split(labelled: DataFrame, label: str, key: str, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split`` with the same share of ``val`` in every label. A big label is spread over many partitions."""
    quota = labelled.groupBy(label).agg(F.round(F.count(F.lit(1)) * ratio).cast("bigint").alias("_quota"))
    rows = positions(labelled.withColumn("_h", seeded(seed, key)), ["_h", key], [label], "_row")
    return rows.join(quota, label).withColumn("split", F.when(F.col("_row") < F.col("_quota"), "val").otherwise("train")).drop("_row", "_h", "_quota")
