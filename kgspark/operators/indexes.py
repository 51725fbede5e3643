"""Path corpus, chain index, pattern index, vocabularies, and encoding with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scalars as S
from ..session import beside, cut_lineage
from .numbering import positions, top_per

OFTEN = 1000  # tokens that are looked up once for all rows


def build_path_corpus(*splits: DataFrame, col: str = "path") -> DataFrame:
    """Distinct path texts of all given splits, sorted, with dense ids: ``(path_id, path)``."""
    rows = None
    for one in splits:
        p = one.select(F.col(col).alias("path")).filter(F.coalesce(F.col(col), F.lit("")) != "")
        rows = p if rows is None else rows.unionByName(p)
    return positions(rows.distinct(), ["path"], name="path_id").select("path_id", "path")


def chain_index(paths: DataFrame, order: list[str]) -> DataFrame:
    """``paths(question, entities, relations, relation_chain, …)`` → one row per chain: frequency, wording, and the first
    five questions and entity lists. Counting is a plain aggregate; the examples are cut to five before the shuffle."""
    freq = paths.groupBy("relation_chain").agg(F.count(F.lit(1)).alias("frequency"), F.first("relations").alias("relations"))
    firsts = top_per(paths.select("relation_chain", "question", "entities", *order), ["relation_chain"], order, 5, "no")
    ex = firsts.groupBy("relation_chain").agg(F.array_sort(F.collect_list(F.struct("no", "question", "entities"))).alias("x"))
    return freq.join(ex, "relation_chain").select(
        "relation_chain", "relations", S.chain_to_text(F.col("relations")).alias("natural_language"), "frequency",
        F.transform("x", lambda x: x["question"]).alias("example_questions"), F.transform("x", lambda x: x["entities"]).alias("example_entities"))


def index_summary(index: DataFrame, k: int = 20) -> DataFrame:
    """The most frequent chains with their wording and first example question, and the totals beside them."""
    totals = index.agg(F.struct(F.count(F.lit(1)).alias("chains"), F.sum("frequency").alias("paths"))).scalar()
    top = index.orderBy(F.col("frequency").desc(), "relation_chain").limit(k)
    return top.withColumn("_t", totals).select("relation_chain", "natural_language", "frequency", F.get("example_questions", F.lit(0)).alias("example"),
                                               F.col("_t.chains").alias("total_chains"), F.col("_t.paths").alias("total_paths"))


def index_text(index: DataFrame) -> DataFrame:
    """The text to embed: the wording and up to three example questions."""
    return index.select("relation_chain", F.concat_ws(" | ", "natural_language", F.slice("example_questions", 1, 3)).alias("text"))


def relation_counts(paths: DataFrame) -> DataFrame:
    """Distinct relations with their number of uses."""
    return paths.select(F.explode("relations").alias("relation")).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def top_chains(paths: DataFrame, k: int = 100) -> DataFrame:
    return paths.groupBy("relation_chain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "relation_chain").limit(k)


# --- vocabularies ----------------------------------------------------------------------------------------------------

def _with_specials(ids: DataFrame, specials: list[str]) -> DataFrame:
    """Specials come first; they are a handful of constant rows."""
    fixed = ids.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(s) for s in specials])).alias("idx", "token")).select(
        "token", F.col("idx").cast("bigint").alias("idx"))
    return fixed.unionByName(ids.select("token", (F.col("idx") + len(specials)).alias("idx")))


def unified_vocabulary(triples: DataFrame, q_entities: DataFrame, a_entities: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity and relation vocabularies over everything given, sorted, dense ids after the specials."""
    ents = triples.select(F.explode(F.array("subj", "obj")).alias("token"))
    for more in (q_entities.select(F.col("entity").alias("token")), a_entities.select(F.col("entity").alias("token")),
                 paths.select(F.explode("entities").alias("token"))):
        ents = ents.unionByName(more)
    rels = triples.select(F.col("rel").alias("token")).unionByName(paths.select(F.explode("relations").alias("token")))
    ids = lambda df: positions(df.distinct(), ["token"], name="idx")
    return _with_specials(ids(ents), C.ENTITY_SPECIALS), _with_specials(ids(rels), C.RELATION_SPECIALS)


def relation_vocabulary(triples: DataFrame, paths: DataFrame) -> DataFrame:
    rels = triples.select(F.col("rel").alias("token")).unionByName(paths.select(F.explode("relations").alias("token"))).distinct()
    return _with_specials(positions(rels, ["token"], name="idx"), C.RELATION_SPECIALS)


def capped_vocabulary(tokens: DataFrame, order: list[str], limit: int | None, specials: list[str]) -> DataFrame:
    """``tokens(token, <order…>)`` → ``(token, idx, n)`` by first appearance with counts; past the limit a token gets the
    unknown index. Sorting is range-partitioned, never one task."""
    per = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("_first"))
    flat = per.select("token", "n", *[F.col("_first")[o].alias(f"_o{i}") for i, o in enumerate(order)])
    ids = positions(flat, [f"_o{i}" for i in range(len(order))] + ["token"], name="idx", start=len(specials))
    unknown = specials.index("<UNK>")
    idx = F.col("idx") if limit is None else F.when(F.col("idx") < limit, F.col("idx")).otherwise(F.lit(unknown))
    return ids.select("token", idx.cast("bigint").alias("idx"), "n")


def encode_tokens(rows: DataFrame, vocab: DataFrame, col: str, out: str = "idx", by: str | None = None) -> DataFrame:
    """Token → index; an unknown token gets 1. The engine broadcasts the vocabulary only when it is small.

    With ``by``, a column without nulls by which the rows lie, only its distinct tokens travel, and the rows stay where they are. Tokens
    that a great many rows have are looked up once and sent to all of them; of the others only those that are known come back.
    """
    v = vocab.select(F.col("token").alias(col), F.col("idx").alias(out))
    if by is not None:
        often = rows.agg(F.expr(f"approx_top_k(`{col}`, {OFTEN}, {10 * OFTEN})").alias("_t")).select(F.explode("_t.item").alias(col)).filter(F.col(col).isNotNull())
        often = cut_lineage(often.distinct().join(v, col, "left").select(col, F.col(out).alias("_idx"), F.lit(True).alias("_often")))
        rows = rows.join(F.broadcast(often), col, "left")
        asked = rows.filter(F.col("_often").isNull() & F.col(col).isNotNull()).select(by, col).distinct().join(v, col)
        return rows.join(beside(asked), [by, col], "left").withColumn(out, F.coalesce("_idx", out, F.lit(1).cast("bigint"))).drop("_idx", "_often")
    return rows.join(v, col, "left").withColumn(out, F.coalesce(out, F.lit(1).cast("bigint")))


def decode_tokens(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """``rows(qid, indices array<bigint>)`` → the separate paths of the sequence ``(qid, path_no, path)``.

    Padding, mask and unknown (and indices outside the vocabulary) end a path; repeats keep their first place. The runs
    are cut inside the row and only real tokens are joined to the vocabulary.
    """
    broken = lambda i: i < len(C.RELATION_SPECIALS)
    # running number of separators before each position, built in the row
    runs = F.aggregate(
        "indices", F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<run:int,idx:bigint>>").alias("out")),
        lambda a, i: F.struct((a["n"] + broken(i).cast("int")).alias("n"),
                              F.when(broken(i), a["out"]).otherwise(F.array_append(a["out"], F.struct(a["n"].alias("run"), i.alias("idx")))).alias("out")))
    flat = rows.select("qid", F.posexplode(runs["out"]).alias("pos", "t")).select("qid", "pos", "t.run", "t.idx")

    def read(named: DataFrame) -> DataFrame:
        runs_text = named.groupBy("qid", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("s")).select(
            "qid", "run", F.array_join(F.transform("s", lambda x: x["token"]), S.SEP).alias("path"))
        once = runs_text.groupBy("qid", "path").agg(F.min("run").alias("path_no"))
        return once.filter(F.col("path") != "").select("qid", "path_no", "path")

    # an index that a sequence has many times is asked once, and no position travels; a null question joins with nothing, so it asks by itself
    named = vocab.select("token", "idx")
    asked = flat.filter("qid is not null").select("qid", "idx").distinct().join(named, "idx")
    return read(flat.join(beside(asked), ["qid", "idx"])).unionByName(read(flat.filter("qid is null").join(named, "idx")))


# --- relation patterns -----------------------------------------------------------------------------------------------

def subgraph_patterns(paths: DataFrame, triples: DataFrame | None = None, examples: int = 10) -> DataFrame:
    """``paths(qid, gid, path_no, entities, relations)`` → patterns with counts; with triples also the first example
    triples (of the earliest paths)."""
    p = paths.filter(F.size("relations") > 0).withColumn("subgraph_id", S.subgraph_id(F.col("relations")))
    out = p.groupBy("subgraph_id").agg(F.count(F.lit(1)).alias("example_count"), F.first("relations").alias("relations"))
    # written out, so that joins know how small it is beside the paths
    out = cut_lineage(out.withColumn("relation_pattern", S.pattern_string(F.col("relations"))))
    if triples is None:
        return out
    from .path_search import path_triples

    # a path contributes at least one triple per relation, so the earliest `examples` paths are enough
    early = cut_lineage(top_per(p.select("subgraph_id", "qid", "gid", "path_no", "entities", "relations"), ["subgraph_id"], ["qid", "path_no"], examples, "_k"))
    steps = path_triples(early, triples).join(early.select("subgraph_id", "qid", "path_no").distinct(), ["qid", "path_no"])
    first = top_per(steps, ["subgraph_id"], ["qid", "path_no", "step"], examples, "_n")
    ex = first.groupBy("subgraph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.struct("subj", "rel", "obj").alias("t")))), lambda x: x["t"]).alias("example_triples"))
    return out.join(ex, "subgraph_id", "left")


def relation_to_patterns(patterns: DataFrame, key: str = "subgraph_id") -> DataFrame:
    """Inverted index in long form: ``(relation, key)``."""
    return patterns.select(F.explode(F.array_distinct("relations")).alias("relation"), key).distinct()


def search_patterns(wanted: DataFrame, patterns: DataFrame, k: int = 10) -> DataFrame:
    """``wanted(qid, relation)`` → patterns by number of wanted relations they hold."""
    inverted = relation_to_patterns(patterns)
    hits = wanted.select("qid", "relation").distinct().join(inverted, "relation").groupBy("qid", "subgraph_id").agg(F.count(F.lit(1)).alias("score"))
    counts = patterns.select("subgraph_id", "example_count")
    return top_per(hits.join(counts, "subgraph_id"), ["qid"], [F.col("score").desc(), F.col("example_count").desc(), F.col("subgraph_id")], k)


def top_patterns(patterns: DataFrame, k: int) -> DataFrame:
    return patterns.orderBy(F.col("example_count").desc(), "subgraph_id").limit(k)


def pattern_totals(patterns: DataFrame) -> DataFrame:
    return patterns.agg(F.count(F.lit(1)).alias("patterns"), F.sum("example_count").alias("examples"))


def graph_pattern_index(triples: DataFrame, listed: bool = False) -> DataFrame:
    """Objects per (relation, subject), a row each; ``listed`` gathers them in one row, for graphs without hub subjects."""
    rows = triples.select("gid", "rel", "subj", "obj", "triple_idx")
    if not listed:
        return rows.distinct()
    return rows.groupBy("gid", "rel", "subj").agg(F.transform(F.array_sort(F.collect_list(F.struct("triple_idx", "obj"))), lambda x: x["obj"]).alias("objects"))
