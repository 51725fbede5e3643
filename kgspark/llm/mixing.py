"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's words lie on a line: its documents stand on it in a seeded order, and the line is cut into blocks of equal length (the
last one shorter). A mix draws whole blocks, each at most once per pass, and one part of a block, so a source gives its target to
the word. Output shards share the drawn blocks like this: the root of a binary tree holds how many blocks each source gives in
all; a node deals its blocks to its two halves by a multivariate-hypergeometric draw, source after source; leaves are shards. Each
source's blocks are permuted by hash, and the shards take disjoint runs of the permuted blocks. ``shuffled`` then orders each
shard locally.

Everything is DataFrame work. Rows of a source are dealt to about sqrt(n) buckets, so positions on the line come from windows of
about sqrt(n) rows. Blocks per source are bounded by ``max_blocks``. Chance is a hash of seed and key: reruns agree.

Defined results: a null text has no words; a null source is a source of its own, last in order, an empty one the first; a source
without words has target 0; rows are told apart by their content, so repeated rows and null ids do no harm; an empty table gives
an empty mix; other columns may have any name.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .core import WORD, query, table, text_of

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
REPEAT = 2.0
BLOCK_WORDS = 1_000  # shortest block
PRIME = 1_000_003
MAX_BLOCKS = 65_536  # of a source and pass; longer sources have longer blocks
SHARD_WORDS = 4_000_000


class Mix(NamedTuple):
    """``pieces(row, start, doc_id, size, source_size, target, shard, turn, first, words)``: ``words`` words of a document from word ``first`` (from 0).

    ``documents(row, start, doc_id, size, source_size, target)`` has every document once; ``row`` is a hash of its content, ``start`` its place on the line.
    """

    documents: DataFrame
    pieces: DataFrame


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeat: float = REPEAT) -> DataFrame:
    """``source, n, source_size, target`` of ``sizes(source, size)``.

    Sources in code point order, null last, take the weights in turn and share ``share`` times all sizes. A source whose part
    exceeds ``repeat`` times its size stops there and the rest is shared again, until no source exceeds its limit. One small
    aggregate per round; the table has one row per source.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1  # a row per source
    per = cut_lineage(per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int"))))
    limit = F.col("source_size") * F.lit(float(repeat))
    total = per.agg((F.sum("source_size") * share).alias("t")).first()["t"] or 0.0
    level = -1.0
    while True:  # all sources under the water level take weight * level, the others their limit
        full = limit <= F.col("weight") * level
        r = per.agg(F.sum(F.when(full, limit)).alias("fixed"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not r["open"] or (total - (r["fixed"] or 0.0)) / r["open"] <= level:
            break
        level = (total - (r["fixed"] or 0.0)) / r["open"]
    return cut_lineage(per.select("source", "n", "source_size", F.least(limit, F.col("weight") * F.lit(max(level, 0.0))).alias("target")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS,
        share: float = SHARE, repeat: float = REPEAT, seed: int = 42, block_words: int = BLOCK_WORDS, max_blocks: int = MAX_BLOCKS, shard_words: int = SHARD_WORDS) -> Mix:
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_of(text_col)).alias("size"),
                       F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col), text).alias("row"))
    rows = cut_lineage(rows)  # texts are read once
    sources = _with_quotas(targets(rows, weights, share, repeat), block_words, max_blocks)
    placed = _placed(rows, sources)
    drawn = cut_lineage(_drawn(sources, seed, shard_words))
    length = F.col("block_len")
    spans = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("size") - 1) / length))))
    low, high = F.greatest("start", F.col("block") * length), F.least(F.col("start") + F.col("size"), F.col("block") * length + F.col("take"))
    both = spans.join(drawn.withColumnRenamed("source_no", "_no"), (F.col("source_no") == F.col("_no")) & (F.col("block") == F.col("_block"))).withColumns(
        {"first": low - F.col("start"), "words": high - low}).filter("words > 0")
    keys = ["row", "start", "doc_id", "size", "source_size", "target"]
    return Mix(placed.select(*keys), both.select(*keys, "shard", "turn", "first", "words"))


def _with_quotas(sources: DataFrame, block_words: int, max_blocks: int) -> DataFrame:
    """Adds the block length, and how many words and blocks a source gives."""
    size = F.col("source_size")
    out = sources.withColumn("source_no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    out = out.withColumn("block_len", F.greatest(F.lit(block_words).cast("long"), F.ceil(size / max_blocks)))
    out = out.withColumns({"blocks": F.ceil(size / F.col("block_len")), "words": F.least(F.round("target").cast("long"), 2 * size)})
    whole = F.when(size > 0, F.floor(F.col("words") / size)).otherwise(0)
    return cut_lineage(out.withColumn("passes", whole).withColumn("rest", F.col("words") - F.col("passes") * size))


def _placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``start``, the place of a document's first word on its source's line."""
    known = sources.select(F.col("source").alias("_source"), "n", "source_no", "source_size", "target", "block_len")
    dealt = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).withColumn("bucket", F.pmod(F.col("row"), F.ceil(F.sqrt("n"))))
    dealt = cut_lineage(dealt.drop("_source", "source", "n"))
    per = dealt.groupBy("source_no", "bucket").agg(F.sum("size").alias("_words"))
    earlier = W.partitionBy("source_no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = per.withColumn("_before", F.coalesce(F.sum("_words").over(earlier), F.lit(0))).drop("_words")
    inside = W.partitionBy("source_no", "bucket").orderBy("row", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    return dealt.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(before, ["source_no", "bucket"]).withColumn(
        "start", F.col("_before") + F.col("_inside"))


def _drawn(sources: DataFrame, seed: int, shard_words: int) -> DataFrame:
    """``source_no, _block, turn, take, shard``: every block the mix takes, on each turn, the words it takes of it, and its shard.

    A block's place in its source's permutation is (a * block + c) mod blocks, with a prime a above every number of blocks;
    documents stand on the line in random order already. Full passes take all blocks, then the first places give the rest: the
    words ahead of a place follow from the block length and the place of the one shorter block, so no window is needed.
    """
    block = sources.filter("source_size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("passes").cast("int")))).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def place(b: Column) -> Column:
        shift = F.pmod(F.xxhash64(F.lit(seed), "source_no", "turn"), F.col("blocks"))
        return F.pmod(b * F.lit(PRIME) + shift, F.col("blocks"))

    short = F.col("blocks") * F.col("block_len") - F.col("source_size")  # what the last block lacks
    length = F.col("block_len") - F.when(F.col("_block") == F.col("blocks") - 1, short).otherwise(0)
    ahead = F.col("place") * F.col("block_len") - F.when(F.col("place") > place(F.col("blocks") - 1), short).otherwise(0)
    part = F.greatest(F.lit(0), F.least(length, F.col("rest") - ahead))
    block = block.withColumn("place", place(F.col("_block"))).withColumn("take", F.when(F.col("turn") < F.col("passes"), length).otherwise(part)).filter("take > 0")
    block = cut_lineage(block.select("source_no", "_block", "turn", "take", (F.col("turn") * F.col("blocks") + F.col("place")).alias("place")))
    quotas = block.groupBy("source_no").agg(F.count(F.lit(1)).alias("quota"), F.sum("take").alias("words"))
    runs = shard_quotas(quotas, seed, shard_words).filter("begin < end").select("source_no", "shard", F.explode(F.sequence(F.col("begin"), F.col("end") - 1)).alias("place"))
    return block.join(runs, ["source_no", "place"]).select("source_no", "_block", "turn", "take", "shard")


def shard_quotas(quotas: DataFrame, seed: int, shard_words: int) -> DataFrame:
    """``source_no, shard, begin, end`` of ``quotas(source_no, quota, words)``: the run of permuted blocks that a shard takes of a source.

    Levels of the tree are projections of one row per node; a node holds one number per source.
    """
    words = quotas.agg(F.sum("words").alias("w")).first()["w"] or 0
    levels = max(0, (max(1, -(-words // shard_words)) - 1).bit_length())
    node = quotas.orderBy("source_no").agg(F.sort_array(F.collect_list(F.struct("source_no", "quota"))).alias("given")).filter(F.size("given") > 0).withColumn("shard", F.lit(0))
    for level in range(levels):
        if level and level % 4 == 0:
            node = node.repartition("shard")
        node = node.select("shard", F.col("given"), _split(F.col("given"), F.col("shard"), level, seed).alias("left"))
        right = F.zip_with("given", "left", lambda g, x: F.struct(g["source_no"].alias("source_no"), (g["quota"] - x["quota"]).alias("quota")))
        node = node.select(F.posexplode(F.array("left", right)).alias("side", "given"), "shard").select((F.col("shard") * 2 + F.col("side")).alias("shard"), "given")
    leaves = cut_lineage(node.select("shard", F.inline("given")))
    upto = W.partitionBy("source_no").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)  # a row per shard
    return leaves.withColumn("end", F.sum("quota").over(upto)).withColumn("begin", F.col("end") - F.col("quota")).select("source_no", "shard", "begin", "end")


def _split(given: Column, shard: Column, level: int, seed: int) -> Column:
    """How much of each source goes left: sources in turn, each by a hypergeometric draw from what is left to place.

    A draw of n of N blocks into m places goes block by block: block i goes left with probability (places left) / (blocks left).
    """
    zero, total = F.lit(0).cast("long"), F.aggregate(given, F.lit(0).cast("long"), lambda a, g: a + g["quota"])
    start = F.struct(total.alias("blocks"), F.floor((total + 1) / 2).alias("places"), F.array().cast("array<struct<source_no:int,quota:bigint>>").alias("left"))

    def source(state, g):
        def one(s, i):
            u = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), shard, g["source_no"], i), F.lit(1 << 40)) / F.lit(float(1 << 40))
            goes = F.when(u * s["blocks"] < s["places"], 1).otherwise(0).cast("long")
            return F.struct((s["blocks"] - 1).alias("blocks"), (s["places"] - goes).alias("places"), (s["went"] + goes).alias("went"))

        ids = F.when(g["quota"] > 0, F.sequence(F.lit(1).cast("long"), g["quota"])).otherwise(F.array().cast("array<bigint>"))
        done = F.aggregate(ids, F.struct(state["blocks"].alias("blocks"), state["places"].alias("places"), zero.alias("went")), one)
        return F.struct(done["blocks"].alias("blocks"), done["places"].alias("places"),
                        F.concat(state["left"], F.array(F.struct(g["source_no"].alias("source_no"), done["went"].alias("quota")))).alias("left"))

    return F.aggregate(given, start, source)["left"]


def shuffled(mixed: DataFrame, seed: int = 42) -> DataFrame:
    """Pieces of a shard together, in random order inside it: one partition per shard at most, sorted locally."""
    return mixed.repartition("shard").sortWithinPartitions("shard", F.xxhash64(F.lit(seed), "row", "turn", "first"), "row", "turn", "first")


def mixed_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix as rows of ``docs``, shuffled inside shards: a document's text once per turn, cut to the words that the turn takes of it.

    Neighbouring blocks of one turn and shard become one row; a document drawn whole keeps its text as it is. Texts are joined by
    the row's hash.
    """
    seed = options.get("seed", 42)
    source_col, id_col = options.get("source_col", "source"), options.get("id_col", "doc_id")
    pieces = mix(docs, text_col=text_col, **options).pieces
    order = W.partitionBy("row", "start", "turn").orderBy("first")  # at most a row per block of one document
    joined = F.when(F.lag(F.col("first") + F.col("words")).over(order) == F.col("first"), 0).otherwise(1)
    runs = pieces.withColumn("_new", joined).withColumn("_run", F.sum("_new").over(order)).groupBy("row", "start", "turn", "_run").agg(
        F.min("size").alias("size"), F.min("first").alias("first"), F.sum("words").alias("words"), F.min("shard").alias("shard"))
    runs = runs.withColumn("_copy", F.dense_rank().over(W.partitionBy("row").orderBy("start")))  # rows that repeat have one place each
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col), F.col(text_col)).alias("row"))
    rows = rows.withColumn("_nth", F.row_number().over(W.partitionBy("row").orderBy("row")))
    text = F.col("_doc").getField(text_col)
    cut = F.rtrim(F.concat_ws("", F.slice(F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)), F.col("first").cast("int") + 1, F.col("words").cast("int"))))
    part = F.when(F.col("words") == F.col("size"), text).otherwise(cut)
    out = shuffled(runs.join(rows, ["row"]).filter("_copy - _nth = 0"), seed)
    return out.select(*[(part if c == text_col else F.col("_doc").getField(c)).alias(c) for c in docs.columns])


def taken(made) -> DataFrame:
    """A row per input row: ``doc_id, size, source_size, target, taken``. Rows without words have no place of their own, so they are not grouped."""
    keys = ["row", "start", "doc_id", "size", "source_size", "target"]
    none = made.documents.select(*keys, F.lit(0).cast("long").alias("words"))
    both = none.filter("size > 0").unionByName(made.pieces.select(*keys, "words"))
    return both.groupBy(*keys).agg(F.sum("words").alias("taken")).unionByName(none.filter("size = 0").withColumnRenamed("words", "taken")).drop("row", "start")


@query("op2_mixing")
def op2(spark, sf_dir):
    return taken(mix(table(spark, sf_dir, "documents")))
