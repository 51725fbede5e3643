"""Near-duplicates by one-permutation hashing with optimal densification, banded buckets and star-shaped candidate edges.

1. One pass over the whole texts gives each document the number of its shingles, a fingerprint of its shingle set, and one key per
   band of its one-permutation signature. An empty bin borrows from the bins of its own fixed probe sequence (optimal
   densification).
2. Equal sets are one class; only its smallest id goes on.
3. Classes that share a band key form a bucket. Its centre is the class with the most bucket mates in all (the base of a family of
   copies rather than one of its variants), and candidate edges run from the members to the centre: as many as members, not
   their square. Hot buckets are joined, never collected, so adaptive execution can split them.
4. Every candidate is confirmed on the full shingle sets, and confirmed links give components.
5. Members that a bucket's star did not bring into one component are compared again, exactly: two sets at the threshold must share
   one of their rarest shingles, so a join on these prefixes (by rising frequency) finds every link left between different
   components. Sizes and a parity sketch, which bounds the difference of two sets from below, are conditions of that join.

With ``BANDS`` bands of ``ROWS`` rows two sets at similarity 0.85 miss every common bucket with probability 6e-11.

Defined results: words are separated by ASCII white space, A-Z are lower-cased; a set holds the distinct runs of ``shingle`` words,
or the whole sequence if there are fewer; a text without words (or null) has an empty set and no links; a row with a null id has no
links, no component, and is kept; rows with equal id and text are one; of rows with equal id and different text, links are checked on
the smallest text; ties go to the smaller id; an empty table gives an empty
result; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .core import lean, query, table
from .components import components

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
SKETCH = 1024  # bits
LONG = 64  # bytes of a word beyond which it is named by a digest
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a fixed public mixing function)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word, from running sums over the bytes: no loop over words."""
    raw = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)  # bytes.lower() touches A-Z only
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[1], blank, [1]]).astype(np.int8))
    first, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(first):
        return np.zeros(0, np.uint64)
    if len(_POWERS.get("up", ())) <= len(raw):
        n = max(1 << 14, 2 * len(raw))
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for name, base in (("up", _ODD), ("down", inverse)):
            _POWERS[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POWERS["up"][: len(raw)])])
    out = _mix((sums[end] - sums[first]) * _POWERS["down"][first] + (end - first).astype(np.uint64))
    for i in np.flatnonzero(end - first > LONG):  # sums modulo 2^64 of long patterns may cancel
        out[i] = int.from_bytes(hashlib.blake2b(raw[first[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    w = _word_hashes(text)
    if not len(w):
        return w
    n = min(shingle, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = _mix(h * _ODD + w[i : len(w) - n + 1 + i])
    return np.unique(h)


def _probes() -> np.ndarray:
    """For each bin a fixed random order in which it asks other bins; 2-universal hashing of (bin, attempt)."""
    i, t = np.arange(BINS, dtype=np.uint64)[:, None], np.arange(4 * BINS, dtype=np.uint64)[None, :]
    return (_mix(i * np.uint64(1 << 32) + t + np.uint64(7)) % np.uint64(BINS)).astype(np.uint8)


PROBES = _probes()


def band_keys(s: np.ndarray) -> np.ndarray:
    """One key per band of the densified one-permutation signature of a non-empty set."""
    shift = np.uint64(64 - BINS.bit_length() + 1)
    bins = (s >> shift).astype(np.int64)
    lowest = np.concatenate([[True], bins[1:] != bins[:-1]])  # the set is sorted: the first of each bin is its minimum
    signature = np.zeros(BINS, np.uint64)
    filled = np.zeros(BINS, bool)
    filled[bins[lowest]] = True
    signature[bins[lowest]] = s[lowest]
    empty = np.flatnonzero(~filled)
    for t in range(PROBES.shape[1]):
        if not len(empty):
            break
        at = PROBES[empty, t]
        ok = filled[at]
        signature[empty[ok]] = signature[at[ok]]
        empty = empty[~ok]
    signature[empty] = s[0]  # a bin that met nobody in all its attempts, which takes a set of a few shingles
    rows = signature.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = _mix(key * _ODD + rows[:, r])
    return key.view(np.int64)


def described(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``doc_id, n_shingles, set (binary fingerprint, null if empty), bands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, mark, bands = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py() or "", shingle)
                size.append(len(s))
                mark.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(band_keys(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(mark, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                                             ["doc_id", "n_shingles", "set", "bands"])

    packed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return packed.mapInArrow(lean(run), f"doc_id {packed.dtypes[0][1]}, n_shingles long, set binary, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` whose full shingle sets have 100 * intersection >= percent * union. ``texts(doc_id, text)``, one row per id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, np.ndarray] = ("", np.zeros(0, np.uint64))  # rows of one centre stand together
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.as_py(), y.as_py()
                if y != last[0]:
                    last = (y, shingle_set(y, shingle))
                s = shingle_set(x, shingle)
                both = len(np.intersect1d(s, last[1], assume_unique=True))
                good.append(100 * both >= percent * (len(s) + len(last[1]) - both))
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield kept.select([0, 1])

    one = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a")
    two = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    kind = dict(pairs.dtypes)
    return two.mapInArrow(lean(run), f"a {kind['a']}, b {kind['b']}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``."""
    rows = cut_lineage(described(docs, id_col, text_col, shingle))
    full = rows.filter("set is not null and doc_id is not null")
    classes = cut_lineage(full.groupBy("set").agg(F.min_by(F.struct("n_shingles", "bands"), "doc_id").alias("s"), F.min("doc_id").alias("rep")).select(
        "set", "rep", "s.n_shingles", "s.bands"))
    members = classes.select("rep", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = cut_lineage(members.join(shared, "key"))  # of buckets with at least two classes
    mates = members.groupBy("rep").agg(F.sum("n").alias("mates"))
    centres = members.join(mates, "rep").groupBy("key").agg(F.min_by("rep", F.struct(-F.col("mates"), F.col("rep"))).alias("centre"))
    stars = members.join(centres, "key").filter("rep <> centre")
    pairs = stars.select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
    texts = _texts(docs, id_col, text_col, members.select("rep").distinct())
    links = cut_lineage(confirmed(cut_lineage(pairs), texts, shingle, percent))
    found = components(links, "a", "b")
    left = _unsettled(members, found)
    if not left.isEmpty():
        more = confirmed(_prefix_pairs(left, texts, shingle, percent), texts, shingle, percent)
        links = cut_lineage(links.unionByName(more))
        found = components(links, "a", "b")
    named = classes.select("set", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set", F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(named, "set", "left")
    own = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def _texts(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """The texts of the classes that share a bucket, written once: ``doc_id, text``. The smallest text stands for a repeated id."""
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
    return cut_lineage(some.groupBy("doc_id").agg(F.min("text").alias("text")))


def _unsettled(members: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, component`` of the members of buckets that still hold several components."""
    placed = members.select("key", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    placed = cut_lineage(placed)
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    return cut_lineage(placed.join(mixed, "key", "left_semi").select(F.col("rep").alias("doc_id"), "component").distinct())


def parities(s: np.ndarray) -> np.ndarray:
    """``SKETCH`` bits, each the parity of the set's members that fall on it. Sets whose bits differ at n places differ by n members at least."""
    odd = np.bincount((_mix(s) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _within_reach(percent: int) -> Column:
    """Whether the sketches of ``a`` and ``b`` leave room for a link: sets of n and m members that have ``percent`` in common differ by at
    most (n + m) * (100 - percent) / (100 + percent) members."""
    differ = F.aggregate(F.zip_with("a.sketch", "b.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return differ * (100 + percent) <= (F.col("a.n") + F.col("b.n")) * (100 - percent)


def _prefix_pairs(left: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``a, b`` of different components that share one of their rarest shingles, with sizes and sketches that allow a link.

    The sketch is a condition of the join: pairs of a large family that lie just under the threshold are compared there and never
    become rows. It can only turn away pairs that are no link.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py() or "", shingle) for t in batch.column(2)]
            lists = [pa.array([f(s) for s in sets], pa.list_(pa.int64())) for f in (lambda s: s.view(np.int64), parities)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["doc_id", "component", "shingles", "sketch"])

    known = left.join(texts, "doc_id").select("doc_id", "component", "text")
    kind = dict(known.dtypes)
    sets = cut_lineage(known.mapInArrow(lean(run), f"doc_id {kind['doc_id']}, component {kind['component']}, shingles array<long>, sketch array<long>"))
    each = sets.select("doc_id", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    # shingles of one document only need no partner, but hold the first places of the prefix
    each = each.join(often, "shingle", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    prefix = each.groupBy("doc_id", "component", "n").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("s"))
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100) + 1
    shared = F.transform(F.filter(F.slice("s", F.lit(1), keep.cast("int")), lambda t: t["often"] > 1), lambda t: t["shingle"])
    prefix = prefix.select("doc_id", "component", "n", shared.alias("p")).join(sets.select("doc_id", "sketch"), "doc_id")
    prefix = cut_lineage(prefix.select("*", F.explode("p").alias("shingle")))
    a, b = prefix.alias("a"), prefix.alias("b")
    fits = (F.col("a.doc_id") < F.col("b.doc_id")) & (F.col("a.component") != F.col("b.component")) & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n"))
    # a pair is made once, at the first shingle that both prefixes hold
    first = F.get(F.array_intersect("a.p", "b.p"), F.lit(0)) == F.col("a.shingle")
    return cut_lineage(a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & fits & _within_reach(percent) & first).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct())


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which one document per component stays, the one with the smallest id."""
    decided = near_duplicates(docs, id_col, text_col, shingle, percent)
    gone = cut_lineage(decided.filter("not kept").select(F.col("doc_id").alias(id_col)).distinct())
    return docs.join(gone, id_col, "left_anti")


@query("op8_near_dedup")
def op8(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
