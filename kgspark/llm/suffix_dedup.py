"""Removal of every byte covered by a long string that starts elsewhere too, by distributed prefix doubling.

Position p is repeated at length h if the h bytes from p also start at another position. Doubling: the name of 2h bytes is the pair of
the names of its halves, and a name that occurs once stays unique at every greater length. Positions go through rounds of growing
length; in each, Spark brings equal names together, unique ones drop out, and the rest go on until they pass the threshold.

All positions as rows would be hundreds of times the input, so positions travel in groups as long as their fate is the same:

1. At ``gram`` bytes: every string of ``length`` bytes has a content-defined sample, the leftmost smallest gram name in it. Strings with
   the same sample form a range, one row. Equal strings have equal samples at the same offset, so samples whose gram name is unique
   drop out with all their strings.
2. A range's whole stretch of bytes gets a name. If it occurs twice, all strings of the range are repeated.
3. What is left lies at the edges of repeated passages. The bytes of these ranges, and of one range of each repeated stretch with the
   same gram, are cut out once into a table bucketed by range. Its strings, told by their offset to the sample, are dealt to nodes of
   ``FAN`` ** k offsets, k falling. The strings of a node have a core in common, which grows to ``length`` as nodes become smaller. A
   core that is unique ends the node: none of its strings is repeated. If the node's whole bytes occur twice, all its strings are
   repeated. Otherwise it goes on as ``FAN`` smaller nodes; of nodes found repeated, one goes along as a partner where an open node has
   its core. At nodes of one offset the core is the string itself, so the answer is exact. An edge costs a few rows per round.

Names are 64-bit hashes of pairs of names, computed by the task that holds the bytes; equality is equality of names (no ranks of all
positions are sorted). Texts are known by a 64-bit hash and their length. Counts are aggregated per task before they are shuffled, and
joined back, so a passage that many texts share is no hot group.

Defined results: a null text is empty; matches lie inside one text; strings are judged on the input; a text shorter than ``length`` keeps
all its bytes; repeated rows repeat each other; ids may be null; an empty table gives an empty result; other columns may have any
name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bucketed, cut_lineage
from .core import lean, query, table

LENGTH = 400
GRAM = 100
FAN = 4
PORTION = 2000  # ranges whose bytes a task names at a time
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def doubled(raw: np.ndarray, least: int, most: int) -> dict[int, np.ndarray]:
    """Names of the h bytes from each position, for the powers of two h that strings of ``least`` to ``most`` bytes need."""
    name, size, out = _mix(raw.astype(np.uint64) + np.uint64(1)), 1, {}
    while size <= most and len(name):
        if 2 * size > least:
            out[size] = name
        name = _mix(name[:-size] * _BASE + name[size:])
        size *= 2
    return out


def name_of(known: dict[int, np.ndarray], at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Names of the ``size`` bytes from ``at``: their first and last power of two bytes, which meet or overlap."""
    power = np.int64(1) << (np.frexp(size)[1].astype(np.int64) - 1)
    out = np.empty(len(at), np.uint64)
    for h in np.unique(power).tolist():
        mine = power == h
        start, long = at[mine], size[mine]
        out[mine] = _mix(_mix(known[h][start] * _BASE + known[h][start + long - h]) + long.astype(np.uint64))
    return out


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest value of each run of w values."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def ranges(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of a text of at least ``length`` bytes: sample, first and last start of the strings that have it, gram name, name of the stretch."""
    w = length - gram + 1
    h = 1 << (gram.bit_length() - 1)
    known = doubled(raw, gram, 2 * length - gram)
    name = _mix(known[h][: len(raw) - gram + 1] * _BASE + known[h][gram - h : len(raw) - h + 1])
    least = _window_min(name, w)
    # leftmost place of each window's least name: the next place at or after the window's start that has it
    at = np.arange(len(least))
    new = np.concatenate([[True], least[1:] != least[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(least)]]) - 1
    rows = []
    for lo, hi in zip(first.tolist(), last.tolist()):
        places = lo + np.flatnonzero(name[lo : hi + w] == least[lo])
        if len(places) == 1:
            rows.append((int(places[0]), lo, hi))
        else:  # equal grams: each string belongs to the leftmost one in it
            mine = places[np.searchsorted(places, at[lo : hi + 1])]
            cut = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            ends = np.concatenate([cut[1:], [hi - lo + 1]]) - 1
            rows += [(int(mine[c]), lo + int(c), lo + int(e)) for c, e in zip(cut, ends)]
    a, lo, hi = (np.array(x, np.int64) for x in zip(*rows))
    stretch = _mix(name_of(known, lo, hi - lo + length) + (a - lo).astype(np.uint64))
    return a, lo, hi, name[a].view(np.int64), stretch.view(np.int64)


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)


def _batch(columns: list, fields: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    named = [f.split() for f in fields.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()).cast(kinds[k]) for c, (_, k) in zip(columns, named)], [n for n, _ in named])


def _sampled(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The ranges of ``texts(key, n, text)`` whose gram occurs twice: ``key, n, a, lo, hi, gram, stretch, whole`` (its stretch occurs twice)."""
    fields = "key long, n int, a int, lo int, hi int, gram long, stretch long"

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for key, n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if n >= length:
                    found = ranges(_bytes(text.as_py()), length, gram)
                    for c, x in zip(out, (np.full(len(found[0]), key), np.full(len(found[0]), n), *found)):
                        c.append(x)
            yield _batch(out, fields)

    found = cut_lineage(texts.select("key", "n", "text").mapInArrow(lean(sample), fields))
    twice = found.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("gram")
    live = cut_lineage(found.join(twice, "gram"))
    whole = live.groupBy("stretch").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("stretch", F.lit(True).alias("whole"))
    return cut_lineage(live.join(whole, "stretch", "left").withColumn("whole", F.coalesce("whole", F.lit(False))))


def _pieces(texts: DataFrame, live: DataFrame, length: int) -> DataFrame:
    """The bytes of the ranges that are still open (``times`` 1) and of their partners (2): ``key, n, lo, hi, a, times, raw``, by range."""
    edges = live.filter("not whole")
    grams = edges.select("gram").distinct()
    partners = live.filter("whole").join(grams, "gram", "left_semi").groupBy("stretch").agg(F.min(F.struct("key", "n", "lo", "hi", "a")).alias("r")).select("r.*", F.lit(2).alias("times"))
    listed = edges.select("key", "n", "lo", "hi", "a", F.lit(1).alias("times")).unionByName(partners)
    lists = cut_lineage(listed.groupBy("key", "n").agg(F.collect_list(F.struct("lo", "hi", "a", "times")).alias("parts")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # copies of a text stand together; one of them is enough
        for batch in batches:
            rows, pieces = [], []
            for key, n, text, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if (key, n) not in seen:
                    seen.add((key, n))
                    raw = _bytes(text.as_py())
                    for p in parts.as_py():
                        rows.append((key, n, p["lo"], p["hi"], p["a"], p["times"]))
                        pieces.append(raw[p["lo"] : p["hi"] + length].tobytes())
            columns = [[np.array(c, np.int64)] for c in zip(*rows)] or [[] for _ in range(6)]
            table = _batch(columns, fields)
            yield pa.RecordBatch.from_arrays([*table.columns, pa.array(pieces, pa.binary())], [*table.schema.names, "raw"])

    fields = "key long, n int, lo int, hi int, a int, times int"
    return bucketed(texts.join(lists, ["key", "n"]).select("key", "n", "text", "parts").mapInArrow(lean(cut), f"{fields}, raw binary"), "key", "n", "lo")


def _named_nodes(work: DataFrame, size: int, length: int, gram: int) -> DataFrame:
    """``work(key, n, lo, hi, a, raw, nodes)`` with a row per node of ``size`` offsets: its own offsets ``first`` to ``last``, and the names of
    the core that the strings of this node share and of all the bytes they cover."""
    fields = "key long, n int, lo int, a int, times int, first int, last int, core long, covered long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PORTION):
                rows = batch.slice(start, PORTION)
                key, n, lo, hi, a = (rows.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
                pieces, nodes = rows.column(5).to_pylist(), rows.column(6)
                base = np.cumsum([0, *map(len, pieces[:-1])])
                at = np.repeat(np.arange(rows.num_rows), nodes.value_lengths().to_numpy(zero_copy_only=False))
                node, times = (nodes.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
                low = node * size
                high = np.minimum(low + size - 1, length - gram)
                first, last = np.maximum(low, (a - hi)[at]), np.minimum(high, (a - lo)[at])
                zero = (base + a - lo)[at]
                known = doubled(np.frombuffer(b"".join(pieces), np.uint8), gram, 2 * length - gram)
                core = _mix(name_of(known, zero - low, length - (high - low)) + low.astype(np.uint64))
                whole = _mix(_mix(name_of(known, zero - last, length + last - first) + first.astype(np.uint64)) + last.astype(np.uint64))
                yield _batch([[x] for x in (key[at], n[at], lo[at], a[at], times, first, last, core.view(np.int64), whole.view(np.int64))], fields)

    return cut_lineage(work.select("key", "n", "lo", "hi", "a", "raw", "nodes").mapInArrow(lean(run), fields))


def repeated(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``key, n, spans``: the first and last starts of the repeated strings of ``texts(key, n, text)``; texts without any are absent."""
    live = _sampled(texts, length, gram)
    pieces = _pieces(texts, live, length)
    sizes = [1]
    while sizes[-1] * FAN <= length - gram:
        sizes.append(sizes[-1] * FAN)
    spans = [live.filter("whole").select("key", "n", "lo", "hi")]
    top = F.transform(F.sequence(F.expr(f"(a - hi) div {sizes[-1]}"), F.expr(f"(a - lo) div {sizes[-1]}")), lambda x: F.struct(x.cast("int").alias("node"), F.col("times").alias("times")))
    work = pieces.withColumn("nodes", top)
    for size in reversed(sizes):
        rows = _named_nodes(work, size, length, gram)
        twice = rows.groupBy("covered").agg(F.sum("times").alias("c")).filter("c > 1").select("covered", F.lit(True).alias("again"))
        rows = cut_lineage(rows.join(twice, "covered", "left"))
        spans.append(rows.filter("again and times = 1").select("key", "n", F.expr("a - last").alias("lo"), F.expr("a - first").alias("hi")))
        if size == 1:
            break
        cores = rows.groupBy("core").agg(F.sum("times").alias("c"), F.bool_or(F.col("again").isNull()).alias("open")).filter("c > 1 and open").select("core")
        going = rows.join(cores, "core", "left_semi")
        partners = going.filter("again").groupBy("covered").agg(F.min(F.struct("key", "n", "lo", "first", "last")).alias("r")).select("r.*", F.lit(2).alias("times"))
        smaller = F.sequence(F.expr(f"int(first div {size // FAN})"), F.expr(f"int(last div {size // FAN})"))
        each = going.filter("again is null").select("key", "n", "lo", "first", "last", "times").unionByName(partners).select("key", "n", "lo", "times", F.explode(smaller).alias("node"))
        work = pieces.join(each.groupBy("key", "n", "lo").agg(F.collect_list(F.struct("node", "times")).alias("nodes")), ["key", "n", "lo"])
    spans = reduce(DataFrame.unionByName, spans)
    return spans.groupBy("key", "n").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept (binary)``: what is left of every text."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text")).withColumn("n", F.octet_length("text"))
    once = texts.select("key", "n", "text")
    spans = cut_lineage(repeated(once, length, gram))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, runs, kept = [], [], [], []
            for text, parts in zip(batch.column(1), batch.column(2)):
                raw = _bytes(text.as_py())
                edge = np.zeros(len(raw) + 1, np.int64)
                for p in parts.as_py() or ():
                    edge[p["lo"]] += 1
                    edge[p["hi"] + length] -= 1
                off = np.cumsum(edge)[:-1] > 0
                size.append(len(raw))
                gone.append(int(off.sum()))
                runs.append(int((np.diff(np.concatenate([[0], off.astype(np.int8)])) == 1).sum()))
                kept.append(raw[~off].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, runs)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = texts.join(spans, ["key", "n"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, f"doc_id {dict(texts.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept binary")


@query("op7_suffix_dedup")
def op7(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
