"""Near-duplicates by SimHash fingerprints, found through deletion-variant signatures.

A fingerprint bit is set if it is set in over half of the hashes (XXH64, seed 42) of the text's shingles, repeats included. Two
fingerprints link at ``bits`` or fewer differing bits.

Search: 64 bits are cut into ``bits // 2 + 1`` segments, so of two linked fingerprints one segment differs by one bit at most. Every
fingerprint is indexed under its one-wildcard variants: for each of the 64 positions, the segment around it without that bit. Linked
fingerprints share a variant, which an equality join finds. 64 rows a fingerprint, whatever the number of texts that have it: equal
fingerprints are one class before anything is joined.

Only which classes hang together is asked, so a bucket (the classes of one variant) never gives all its pairs:

1. The smallest id of a bucket is its centre; members within reach of it are links. Links give components.
2. In buckets that still hold several components, the members outside the largest one meet all members. Distance, different components and
   "the first variant that both share" are conditions of the join, so a row is made only for a true link, once. This makes the
   result exact.

Each step is one shuffle of 64 short rows a class; what shares a bucket by chance is compared where it lies and never written. With three
segments a bucket's key has 20 bits, so chance meetings stay cheap up to some ten million different texts and then grow with the square.

Defined results: words are separated by ASCII white space, A-Z are lower-cased; with fewer words than a shingle the whole sequence is the one
shingle; without words (or null) the fingerprint is zero and links like any other; a row with a null id has a fingerprint, no links and no
component; repeated rows are equal fingerprints; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components
from .core import query, table

PORTION = 1 << 15  # shingles hashed at a time


def fingerprint(text: str, shingle: int = 4) -> int:
    """The 64 bits of a text, as an unsigned number."""
    words = text.encode("utf-8", "replace").lower().split()  # of bytes: touches A-Z only, splits at ASCII white space only
    if not words:
        return 0
    n = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.concatenate([[0], ends[:-1]])[: len(words) - n + 1]
    last = ends[n - 1 :] - 1
    one = xxhash.xxh64_intdigest
    set_in = np.zeros(64, np.int64)
    for i in range(0, len(first), PORTION):
        spans = zip(first[i : i + PORTION].tolist(), last[i : i + PORTION].tolist())
        h = np.fromiter((one(joined[a:b], 42) for a, b in spans), "<u8")
        set_in += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``doc_id, mark (long: the 64 bits)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.fromiter((fingerprint(t.as_py() or "", shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], ["doc_id", "mark"])

    packed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return packed.mapInArrow(run, f"doc_id {packed.dtypes[0][1]}, mark long")


def segments(bits: int) -> list[tuple[int, int]]:
    """First and last but one position of each segment."""
    n = bits // 2 + 1
    return [(64 * i // n, 64 * (i + 1) // n) for i in range(n)]


def variants(mark: str, bits: int) -> Column:
    """Per position the bits of its segment without the one at the position, as an array of 64."""
    masks = [sum(1 << b for b in range(low, high) if b != p) for low, high in segments(bits) for p in range(low, high)]
    return F.array(*[F.col(mark).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _shared_place(x: Column, bits: int) -> Column:
    """The least position whose variant two marks share, from the exclusive or of both; null if they share none."""
    places = []
    for low, high in segments(bits):
        mask = (1 << high) - (1 << low)
        part = x.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        # of a single bit: its position, through the ones below it
        at = F.when(part == 1, 0).otherwise(1 + F.bit_count(F.shiftrightunsigned(part, 1) - 1))
        places.append(F.when(part == 0, low).when(F.bit_count(part) == 1, at))
    return F.coalesce(*places)


def linked(marks: DataFrame, bits: int = 4) -> DataFrame:
    """``mark, component`` (the smallest ``rep`` reachable) of ``marks(mark, rep)``, one row per mark; marks without links are absent."""
    bucket = Window.partitionBy("place", "rest")
    each = marks.select("rep", "mark", F.posexplode(variants("mark", bits)).alias("place", "rest"))
    starred = each.withColumn("centre", F.first(F.struct("rep", "mark")).over(bucket.orderBy("rep")))
    stars = starred.filter((F.col("rep") != F.col("centre.rep")) & (_distance("mark", "centre.mark") <= bits))
    links = cut_lineage(stars.select(F.col("rep").alias("a"), F.col("centre.rep").alias("b")).distinct())
    named = components(links, "a", "b").withColumnRenamed("node", "rep")
    placed = cut_lineage(marks.select("mark", "rep").join(named, "rep", "left").select("mark", "rep", F.coalesce("component", "rep").alias("component")))
    links = cut_lineage(links.unionByName(_cross_links(placed, bits)))
    named = components(links, "a", "b").withColumnRenamed("node", "rep")
    return marks.join(named, "rep").select("mark", "component")


def _cross_links(placed: DataFrame, bits: int) -> DataFrame:
    """``a, b``: all links between different components of ``placed(mark, rep, component)``, each once."""
    bucket = Window.partitionBy("place", "rest")
    each = placed.select("rep", "mark", "component", F.posexplode(variants("mark", bits)).alias("place", "rest"))
    sized = each.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("place", "rest", "component")))
    told = sized.select("*", F.max(F.struct("n", "component")).over(bucket).alias("most"), F.min("component").over(bucket).alias("low"), F.max("component").over(bucket).alias("high"))
    mixed = told.filter("low <> high").select("rep", "mark", "component", "place", "rest", (F.col("component") == F.col("most.component")).alias("main"))
    o, m = mixed.filter("not main").alias("o"), mixed.alias("m")
    x = F.col("o.mark").bitwiseXOR(F.col("m.mark"))
    once = (F.col("m.main") | (F.col("o.rep") < F.col("m.rep"))) & (_shared_place(x, bits) == F.col("o.place"))
    meets = (F.col("o.place") == F.col("m.place")) & (F.col("o.rest") == F.col("m.rest")) & (F.col("o.component") != F.col("m.component"))
    return o.join(m, meets & (F.bit_count(x) <= bits) & once).select(F.col("o.rep").alias("a"), F.col("m.rep").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint (16 hexadecimal digits), component_id``."""
    rows = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    classes = cut_lineage(rows.filter("doc_id is not null").groupBy("mark").agg(F.min("doc_id").alias("rep")))
    named = classes.join(linked(classes, bits), "mark", "left").select("mark", F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(named, "mark", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


@query("op11_simhash")
def op11(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
