"""BM25, dense and hybrid search for all questions in one job, and the rules built on search results."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import beside, bucketed, cut_lineage
from . import ranking as R
from .filters import filter_by_relations, hop_filter, is_machine_id, min_score
from .numbering import first_per, top_per
from .traversal import follow_path_flexible, one_hop_keyword_fallback


ROWS_PER_PART = 1_000_000  # postings of one term are split into parts of about this size


class Bm25Index(NamedTuple):
    """``postings(term, part, path_id, gain)``, kept together per path; ``terms(term, df, parts, idf)``; ``corpus(path_id)``."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame


def bm25_index(corpus: DataFrame, tokenizer: str = "path", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25,
               rows_per_part: int = ROWS_PER_PART) -> Bm25Index:
    """Okapi statistics of ``corpus(path_id, path)``. ``idf * gain`` is what one occurrence of the term in a query adds; only the terms that
    are asked for bring their idf to the postings.

    The text is shuffled once, by path; counting terms then needs no further shuffle. Frequent terms get a part number
    so that one term can be joined by many tasks. A negative idf becomes ``epsilon`` times the mean idf.
    """
    tokens = corpus.repartition("path_id").select("path_id", S.TOKENIZERS[tokenizer](F.col("path")).alias("t"))
    tf = tokens.select("path_id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("path_id", "len", "term").agg(
        F.count(F.lit(1)).alias("tf"))
    tf = bucketed(tf, "path_id", placed=True)
    n = corpus.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    # every path has one row per distinct term, so its length is taken once
    length = tf.groupBy("path_id").agg(F.max("len").alias("len")).agg(F.sum("len").cast("double").alias("s")).scalar()
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = cut_lineage(df.withColumn("raw", raw).withColumn("parts", F.ceil(F.col("df") / rows_per_part).cast("int")))
    mean = terms.agg(F.avg("raw").alias("m")).scalar()
    idf = F.when(F.col("raw") < 0, epsilon * mean).otherwise(F.col("raw"))
    split = cut_lineage(terms.filter("parts > 1").select("term", F.col("parts").alias("_parts")))  # few: a posting stays where its path lies
    part = F.pmod(F.xxhash64("path_id"), F.coalesce("_parts", F.lit(1))).cast("int")
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / (length / n)))
    postings = tf.join(split, "term", "left").select("term", part.alias("part"), "path_id", gain.alias("gain"))
    return Bm25Index(postings, terms.select("term", "df", "parts", idf.alias("idf")), corpus.select("path_id"))


def bm25_search(questions: DataFrame, index: Bm25Index, k: int | None, tokenizer: str = "path", text: str = "question",
                fill: bool = False) -> DataFrame:
    """Best k paths per question by summed impact; a repeated query term counts again. ``k=None`` returns all matches.

    Terms meet their postings by (term, part), where frequent terms have several parts; whether the questions are sent to the
    postings instead is left to the optimizer, which knows their size.
    """
    q = questions.select("qid", F.explode(S.TOKENIZERS[tokenizer](F.col(text))).alias("term")).groupBy("qid", "term").agg(
        F.count(F.lit(1)).alias("qtf"))
    asked = cut_lineage(q.join(index.terms.select("term", "parts", "idf"), "term"))  # its size is known to the join
    spread = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    hits = index.postings.join(spread, ["term", "part"])
    scored = hits.groupBy("path_id", "qid").agg(F.round(F.sum(F.col("qtf") * (F.col("idf") * F.col("gain"))), 9).alias("score"))
    if k is None:
        return scored.select("qid", "path_id", "score")
    best = R.top_k(scored, k).select("qid", "rank", "score", "path_id")
    return _fill(questions, best, index, k) if fill else best


def _fill(questions: DataFrame, best: DataFrame, index: Bm25Index, k: int) -> DataFrame:
    """Top up short lists with unmatched paths, which score 0, in path order. A list with fewer than k matches needs at
    most k others, and these are among the 2k first paths."""
    first = index.corpus.orderBy("path_id").limit(2 * k).agg(F.collect_list("path_id").alias("ids")).scalar()
    have = best.groupBy("qid").agg(F.count(F.lit(1)).alias("have"))
    short = questions.select("qid").join(have, "qid", "left").filter(F.coalesce("have", F.lit(0)) < k)
    spare = short.select("qid", F.explode(first).alias("path_id")).join(best.select("qid", "path_id"), ["qid", "path_id"], "left_anti")
    return R.top_k(best.drop("rank").unionByName(spare.withColumn("score", F.lit(0.0))), k).select("qid", "rank", "score", "path_id")


# --- vectors ---------------------------------------------------------------------------------------------------------

def normalise(vec: Column) -> Column:
    """Scale to length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return S.let(norm, lambda n: F.transform(vec, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double"))))


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def _cell_top(k: int):
    """Top k of one (query block, corpus block) cell by matrix product; equal scores by path id."""
    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        if q.num_rows == 0 or c.num_rows == 0:
            return pa.table({"qid": q.column("qid").slice(0, 0), "path_id": c.column("path_id").slice(0, 0), "score": pa.array([], pa.float64())})
        order = pc.sort_indices(c.column("path_id"))  # ids keep their type: numbers or texts
        ids, mat = c.column("path_id").take(order), _matrix(c.column("vec"))[order.to_numpy()].T
        qids, qmat = q.column("qid"), _matrix(q.column("vec"))
        keep = min(k, len(ids))
        out_q, out_p, out_s = [], [], []
        for lo in range(0, len(qids), 128):
            scores = np.round(qmat[lo:lo + 128] @ mat, 9)
            cut = np.partition(scores, len(ids) - keep, axis=1)[:, len(ids) - keep]
            for row in range(len(scores)):
                cand = np.flatnonzero(scores[row] >= cut[row])
                best = cand[np.argsort(-scores[row][cand], kind="stable")[:keep]]
                out_q.append(np.full(len(best), lo + row))
                out_p.append(best)
                out_s.append(scores[row][best])
        return pa.table({"qid": qids.take(pa.array(np.concatenate(out_q))), "path_id": ids.take(pa.array(np.concatenate(out_p))), "score": np.concatenate(out_s)})

    return run


def _search_cells(q: DataFrame, c: DataFrame, k: int) -> DataFrame:
    """``q(cell, qid, vec)`` against ``c(cell, path_id, vec)`` with equal cell; then the best k over all cells."""
    schema = f"qid {dict(q.dtypes)['qid']}, path_id {dict(c.dtypes)['path_id']}, score double"
    part = q.groupBy("cell").cogroup(c.groupBy("cell")).applyInArrow(_cell_top(k), schema)
    return R.top_k(part, k).select("qid", "rank", "score", "path_id")


def _blocks(rows: int, per_block: int) -> int:
    return max(1, -(-rows // per_block))


def dense_search(queries: DataFrame, corpus: DataFrame, k: int, query_block: int = 2048, block_bytes: int = 64 << 20) -> DataFrame:
    """Exact inner product: ``queries(qid, vec)``, ``corpus(path_id, vec)``.

    Both sides are hashed into blocks of bounded size and each pair of blocks meets in one task, which multiplies two
    matrices and keeps k rows per query. Few queries make one query block, and then every corpus vector moves once.
    """
    first = corpus.select(F.size("vec").alias("d")).head()
    per_block = max(1024, block_bytes // (4 * max(1, first["d"] if first else 1)))
    qb, cb = _blocks(queries.count(), query_block), _blocks(corpus.count(), per_block)
    fl = lambda: F.col("vec").cast("array<float>").alias("vec")
    q = queries.select(F.col("qid"), fl(), F.pmod(F.xxhash64("qid"), F.lit(qb)).alias("b"),
                       F.explode(F.sequence(F.lit(0), F.lit(cb - 1))).alias("o"))
    c = corpus.select(F.col("path_id"), fl(), F.pmod(F.xxhash64("path_id"), F.lit(cb)).alias("b"),
                      F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("o"))
    return _search_cells(q.select((F.col("b") * cb + F.col("o")).alias("cell"), "qid", "vec"),
                         c.select((F.col("o") * cb + F.col("b")).alias("cell"), "path_id", "vec"), k)


def dense_search_ivf(queries: DataFrame, corpus: DataFrame, k: int, nlist: int = 100, nprobe: int = 10, seed: int = 42,
                     rows_per_part: int = 65536) -> DataFrame:
    """Approximate search: cluster the corpus, look only into the ``nprobe`` nearest clusters of each query.

    Tasks get the ``nlist`` centroids as one broadcast matrix (``nlist`` times the dimension, whatever the size of the corpus) and find the
    nearest ones of a batch of queries by one product. A cluster that holds many vectors is split into parts of bounded size. With
    ``nprobe = nlist`` the search is exact.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = corpus.select(F.col("path_id"), "vec", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    model = KMeans(k=nlist, seed=seed, maxIter=10, featuresCol="features", predictionCol="cluster").fit(vectors)
    placed = cut_lineage(model.transform(vectors).select("path_id", "vec", "cluster"))
    parts = placed.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / rows_per_part).cast("bigint").alias("parts"))  # nlist rows
    width = F.lit(1 << 20)
    fl = F.col("vec").cast("array<float>").alias("vec")
    c = placed.join(parts, "cluster").select((F.col("cluster") * width + F.pmod(F.xxhash64("path_id"), F.col("parts"))).alias("cell"), "path_id", fl)
    centres = queries.sparkSession.sparkContext.broadcast(np.array([np.asarray(m, np.float64) for m in model.clusterCenters()]))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = centres.value
        square = (m * m).sum(axis=1)
        for batch in batches:
            if batch.num_rows:
                # nearest centroids: |x|^2 is the same for all, so compare |m|^2 - 2 x.m
                near = np.argsort(square - 2 * (_matrix(batch.column(1)) @ m.T), axis=1, kind="stable")[:, :nprobe]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel(), pa.int32()), near.shape[1]).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["qid", "vec", "probes"])

    asked = queries.select("qid", fl)
    q = asked.mapInArrow(probe, f"qid {dict(asked.dtypes)['qid']}, vec array<float>, probes array<int>").select("qid", "vec", F.explode("probes").alias("cluster"))
    q = q.join(parts, "cluster").select("qid", "vec", "cluster", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("p"))
    return _search_cells(q.select((F.col("cluster") * width + F.col("p")).alias("cell"), "qid", "vec"), c, k)


# --- combinations ----------------------------------------------------------------------------------------------------

def hybrid_search(bm25: DataFrame, dense: DataFrame, k: int, fusion: str = "rrf", alpha: float = 0.5) -> DataFrame:
    """Fuse two lists of (up to) 2k and keep k."""
    a, b = bm25.filter(F.col("rank") <= 2 * k), dense.filter(F.col("rank") <= 2 * k)
    return R.rrf_fuse([a, b], k) if fusion == "rrf" else R.minmax_fuse(a, b, k, alpha)


def small_corpus_bypass(questions: DataFrame, corpus: DataFrame, search, n: int = 1000) -> DataFrame:
    """With at most n paths every path is a candidate of every question, unscored and in path order; else ``search()``.

    The few paths travel as one array value; more than n are never gathered.
    """
    if corpus.limit(n + 1).count() > n:
        return search()
    all_ids = corpus.agg(F.array_sort(F.collect_list("path_id")).alias("ids")).scalar()
    return questions.select("qid", F.posexplode(all_ids).alias("i", "path_id")).select(
        "qid", (F.col("i") + 1).alias("rank"), F.lit(0.0).alias("score"), "path_id")


def retrieve_filter_topk(ranked: DataFrame, k: int, threshold: float | None = None, relations: list[str] | None = None,
                         qtypes: DataFrame | None = None, frequency: DataFrame | None = None, over: int | None = None) -> DataFrame:
    """From an over-retrieved list (when filtering ``over`` · k, all without it) to the final k: score, relation and hop filters, boost."""
    filtering = relations is not None or qtypes is not None
    first = k if not filtering else None if over is None else over * k
    r = ranked.filter(F.col("rank") <= first) if "rank" in ranked.columns and first is not None else ranked
    if threshold is not None:
        r = min_score(r, threshold)
    if relations is not None:
        r = filter_by_relations(r, relations)
    if qtypes is not None:
        r = hop_filter(r, qtypes).select(*ranked.columns)
    return R.frequency_boost(r, frequency, k) if frequency is not None else R.top_k(r, k)


def hyde_text(question: Column, hypothetical: Column, append: bool = True) -> Column:
    """The search text: a supplied hypothetical path instead of the question, or after it."""
    return F.concat(question, F.lit(" Expected Path: "), hypothetical) if append else F.coalesce(hypothetical, question)


def candidate_entities(questions: DataFrame, topics: DataFrame, ranked: DataFrame, triples: DataFrame, max_hops: int,
                       top_paths: int | None = None, cap: int | None = None, fallback: bool = True, by_graph: bool = False) -> DataFrame:
    """Entities along the top paths in path order without repeats, the one-hop fallback, the first ``cap`` (all without one)."""
    per = follow_path_flexible(topics, ranked if top_paths is None else ranked.filter(F.col("rank") <= top_paths), triples, max_hops, by_graph)
    once = first_per(per.select("qid", "entity", "rank", "trail"), ["qid", "entity"], ["rank", "trail"])
    # the fallback only concerns lists of fewer than three, so cutting first changes nothing
    found = top_per(once, ["qid"], ["rank", "trail", "entity"], cap, "pos").select("qid", "pos", "entity")
    if fallback:
        found = one_hop_keyword_fallback(questions, topics, found, triples)
    return found if cap is None else found.filter(F.col("pos") <= cap)


def path_entities(topics: DataFrame, ranked: DataFrame, triples: DataFrame, max_hops: int, per_path: int | None = None,
                  by_graph: bool = False) -> DataFrame:
    """The first ``per_path`` entities (all without it; ignoring case) along each ranked path: ``(qid, rank, path, no, entity)``."""
    per = follow_path_flexible(topics, ranked, triples, max_hops, by_graph).withColumn("low", F.lower("entity"))
    once = first_per(per, ["qid", "rank", "low"], ["trail", "entity"])
    return top_per(once, ["qid", "rank"], ["trail", "entity"], per_path, "no").select("qid", "rank", "path", "no", "entity")


def gold_matches(ranked: DataFrame, gold: DataFrame, within: int | None = None) -> DataFrame:
    """Analysis only, it looks at gold: the ranked paths, among the first ``within`` if given, that are gold ones (ignoring case)."""
    low = gold.select("qid", F.lower("path").alias("low")).distinct()
    first = ranked if within is None else ranked.filter(F.col("rank") <= within)
    return first.withColumn("low", F.lower("path")).join(beside(low), ["qid", "low"], "left_semi").select(*ranked.columns)


def direct_selection(ranked: DataFrame, gold: DataFrame, entities: DataFrame, within: int | None = None, per_path: int | None = None) -> DataFrame:
    """Analysis only, it looks at gold: the first ``per_path`` entities of the last matching path among the first ``within``, comma-joined,
    or null; all entities and all paths without these bounds.

    ``entities`` is the output of ``path_entities``; that of the paths in ``gold_matches`` is enough.
    """
    match = gold_matches(ranked, gold, within).select("qid", "rank")
    e = (entities if per_path is None else entities.filter(F.col("no") <= per_path)).join(beside(match), ["qid", "rank"], "left_semi")
    # the list of each path, of which the last one's stays
    listed = e.groupBy("qid", "rank").agg(F.array_sort(F.collect_list(F.struct("no", "entity"))).alias("s"))
    text = listed.groupBy("qid").agg(F.max_by("s", "rank").alias("s"))
    return ranked.select("qid").distinct().join(beside(text), "qid", "left").select("qid", F.array_join(F.transform("s", lambda x: x["entity"]), ", ").alias("answer"))


def entities_from_paths(ranked: DataFrame, gold: DataFrame | None = None, top_paths: int | None = None, cap: int | None = None,
                        within: int | None = None) -> DataFrame:
    """Entities written in the path texts, in order, without repeats, the first ``cap`` (all without one). With gold (analysis only) just
    those of the first matching path, looked for among the first ``within`` if given."""
    r = ranked if top_paths is None else ranked.filter(F.col("rank") <= top_paths)
    if gold is not None:
        low = gold.select("qid", F.lower("path").alias("low")).distinct()
        hit = (r if within is None else r.filter(F.col("rank") <= within)).withColumn("low", F.lower("path")).join(low, ["qid", "low"], "left_semi")
        r = first_per(hit.drop("low"), ["qid"], ["rank"])
    rows = r.select("qid", "rank", F.posexplode(S.entities_of_path(F.col("path"))).alias("i", "entity")).filter(~is_machine_id(F.col("entity")))
    once = first_per(rows, ["qid", "entity"], ["rank", "i"])
    return top_per(once, ["qid"], ["rank", "i"], cap, "pos").select("qid", "pos", "entity")
