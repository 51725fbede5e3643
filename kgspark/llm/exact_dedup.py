"""Exact deduplication by skew-safe combining.

Equal texts are combined three times: inside each map task (partial aggregate), per salted digest group, and over the salt
winners. Every stage groups by the digest *and* the whole text, so content is compared, not only digests. A text held by a third
of all rows becomes one row per map task before it is shuffled, and ``salts`` groups after that.

Defined results: a null text counts as empty; a null id is smaller than any other; rows that repeat both id and text are all
marked kept by ``copies`` and give one row in ``keep_one``; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .core import query, table, text_of

SALTS = 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, digest, keep_id`` (largest id among equal texts), ``group_size, kept``.

    Texts meet in the three combining stages; what follows is joined by digest. Only where a digest is found to stand for several
    texts (never seen with SHA-256) are its rows joined by digest and text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("digest", digest(F.col("text")))
    winners = _combine(rows, salts)
    groups = cut_lineage(winners.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    out = rows.select("doc_id", "digest").join(groups.filter("texts = 1"), "digest")
    clashes = groups.filter("texts > 1").select("digest")
    if not clashes.isEmpty():
        some = rows.join(clashes, "digest", "left_semi")
        out = out.unionByName(some.join(_combine(some, salts), ["digest", "text"]).drop("text").withColumn("texts", F.lit(2)))
    return out.select("doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def _combine(rows: DataFrame, salts: int) -> DataFrame:
    """``digest, text, keep_id, group_size`` of ``rows(doc_id, text, digest)``; rows of a digest stand in one partition."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts))).groupBy("digest", "salt", "text").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return salted.repartition("digest").groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` without copies: of equal texts the row with the largest id stays, with all its columns.

    The other columns travel with the text through the same stages, so nothing is joined back. Rows of equal id and text are told
    apart by a hash of their other columns.
    """
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(*[F.col(f"`{c}`") for c in others], F.col(text_col).isNull().alias("_null_text"))
    rank = F.struct(F.col(id_col).alias("id"), F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in others], F.col(text_col)).alias("tie"))
    rows = docs.select(text_of(text_col).alias("text"), rank.alias("rank"), row.alias("row")).withColumn("digest", sha256(F.col("text")))
    salted = rows.withColumn("salt", F.pmod(F.col("rank.tie"), F.lit(salts))).groupBy("digest", "salt", "text").agg(
        F.max_by("row", "rank").alias("row"), F.max("rank").alias("rank"))
    best = salted.groupBy("digest", "text").agg(F.max_by("row", "rank").alias("row"))
    back = {c: F.col("row").getField(c) for c in others} | {text_col: F.when(~F.col("row._null_text"), F.col("text"))}
    return best.select(*[back[c].alias(c) for c in docs.columns])


@query("op4_exact_dedup", """with t as (select doc_id, coalesce(text, '') text from documents)
  select doc_id, max(doc_id) over w keep_id, count(*) over w group_size, doc_id is not distinct from max(doc_id) over w kept, sha256(text) text_sha256
  from t window w as (partition by text)""")
def op4(spark, sf_dir):
    found = copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
