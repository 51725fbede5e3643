"""Tables for training retrievers, rerankers, generators and readers; augmentation that is fixed by a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scalars as S
from ..session import beside, bucketed
from .numbering import first_per, top_per

# Primes; one that does not divide the corpus size is a step that visits every path once.
_STEPS = [1000000007, 998244353, 2147483647, 1000000009, 67280421, 4294967291]


def chance(seed: int | str, *parts: Column | str) -> Column:
    """A number in 0…1 fixed by seed and keys."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 4294967296.0


def hard_negatives(ranked: DataFrame, gold: DataFrame, k: int = 7, pool: int | None = None) -> DataFrame:
    """The best k (of the first ``pool``, if given) that are no gold path: ``(qid, no, path)``."""
    g = gold.select("qid", S.norm_path(F.col("path")).alias("key")).distinct()
    r = (ranked if pool is None else ranked.filter(F.col("rank") <= pool)).withColumn("key", S.norm_path(F.col("path")))
    left = r.join(g, ["qid", "key"], "left_anti").select("qid", F.col("rank").alias("_at"), "path")
    return top_per(left, ["qid"], ["_at"], k, "no").drop("_at")


def random_negatives(questions: DataFrame, corpus: DataFrame, exclude: DataFrame, k: int = 3, seed: int = 42, size: int | None = None) -> DataFrame:
    """k corpus paths per question outside ``exclude(qid, path)``: ``(qid, no, path)``.

    No question meets the whole corpus: it walks the dense ids from a seeded start in steps of a prime, draws as many
    ids as it may have to throw away plus k, and joins those. The ids of one walk are distinct, so k are left whenever
    the corpus has them. ``corpus(path_id, path)`` has dense ids from 0; ``size`` is their number if known.
    """
    n = corpus.count() if size is None else size
    if n == 0:
        return questions.select("qid", F.lit(1).alias("no"), F.lit("").alias("path")).limit(0)
    step = next(p for p in _STEPS if n % p != 0 or n == 1)
    ex = exclude.select("qid", S.norm_path(F.col("path")).alias("key")).distinct()
    # several spellings may share one normal form: count the corpus paths that are excluded, not the forms
    spelled = corpus.groupBy(S.norm_path(F.col("path")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    out = ex.join(spelled, "key").groupBy("qid").agg(F.sum("n").alias("out"))
    start = F.floor(chance(seed, "qid") * n).cast("bigint")
    draws = questions.select("qid").join(out, "qid", "left").select(
        "qid", start.alias("s"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.coalesce("out", F.lit(0)) + k, F.lit(n)) - 1)).alias("i"))
    drawn = draws.select("qid", "i", F.pmod(F.col("s") + F.col("i") * F.lit(step % n), F.lit(n)).alias("path_id")).join(corpus.select("path_id", "path"), "path_id")
    kept = drawn.withColumn("key", S.norm_path(F.col("path"))).join(ex, ["qid", "key"], "left_anti")
    return top_per(kept.select("qid", "i", "path"), ["qid"], ["i"], k, "no").drop("i")


def _listed(rows: DataFrame, name: str) -> DataFrame:
    """Lists of a fixed small length (k is given by the caller)."""
    return rows.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "path"))), lambda x: x["path"]).alias(name))


def contrastive_examples(questions: DataFrame, ranked: DataFrame, gold: DataFrame, corpus: DataFrame, hard: int = 7, rand: int = 3, seed: int = 42) -> DataFrame:
    """``(qid, query, positive, hard_negatives, random_negatives)``: first gold path, mined and random negatives."""
    first = first_per(gold.select("qid", "path_no", "path"), ["qid"], ["path_no"]).select("qid", F.col("path").alias("positive"))
    asked = questions.join(first, "qid")
    h = hard_negatives(ranked, gold, hard)
    r = random_negatives(asked, corpus, gold.select("qid", "path").unionByName(h.select("qid", "path")), rand, seed)
    none = F.array().cast("array<string>")
    return asked.join(_listed(h, "hard_negatives"), "qid", "left").join(_listed(r, "random_negatives"), "qid", "left").select(
        "qid", F.col("question").alias("query"), "positive", F.coalesce("hard_negatives", none).alias("hard_negatives"),
        F.coalesce("random_negatives", none).alias("random_negatives"))


def triplets(examples: DataFrame) -> DataFrame:
    """One row per negative, or one with an empty negative."""
    return examples.select("qid", F.col("query").alias("anchor"), "positive", F.posexplode_outer(F.concat("hard_negatives", "random_negatives")).alias("no", "n")).select(
        "qid", "anchor", "positive", F.coalesce("no", F.lit(0)).alias("no"), F.coalesce("n", F.lit("")).alias("negative"))


def random_triplets(questions: DataFrame, gold: DataFrame, corpus: DataFrame, seed: int = 42, limit: int | None = None) -> DataFrame:
    """Every (question, gold path) with one other path; ``limit`` caps the validation table, which the task asks for."""
    key = F.concat_ws(":", "qid", "path_no")
    pairs = gold.select("qid", "path_no", "path", key.alias("pair"))
    own = pairs.select(F.col("pair").alias("qid"), "path")
    neg = random_negatives(own.select("qid"), corpus, own, 1, seed).select(F.col("qid").alias("pair"), F.col("path").alias("negative"))
    rows = pairs.join(neg, "pair").join(questions.select("qid", "question"), "qid").select(
        "qid", "path_no", F.col("question").alias("anchor"), F.col("path").alias("positive"), "negative")
    return rows if limit is None else rows.orderBy("qid", "path_no").limit(limit)


def reranker_pairs(examples: DataFrame, negatives: int = 3) -> DataFrame:
    """``(qid, query, doc, label)``: the positive and the first negatives."""
    docs = F.concat(F.array(F.struct(F.col("positive").alias("doc"), F.lit(1).alias("label"))),
                    F.transform(F.slice(F.concat("hard_negatives", "random_negatives"), 1, negatives), lambda d: F.struct(d.alias("doc"), F.lit(0).alias("label"))))
    return examples.select("qid", "query", F.posexplode(docs).alias("no", "d")).select("qid", "no", "query", "d.doc", "d.label")


def reranker_eval_sets(examples: DataFrame) -> DataFrame:
    return examples.select("qid", "query", F.array("positive").alias("positive"),
                           F.concat(F.slice("hard_negatives", 1, 3), F.slice("random_negatives", 1, 2)).alias("negative"))


def candidate_pool(questions: DataFrame, gold: DataFrame, corpus: DataFrame, n: int = 99, seed: int = 42) -> DataFrame:
    """Gold paths and n random others with labels, in seeded order: ``(qid, no, path, label)``."""
    neg = random_negatives(questions, corpus, gold, n, seed).select("qid", "path", F.lit(0).alias("label"))
    rows = gold.select("qid", "path").distinct().withColumn("label", F.lit(1)).unionByName(neg).withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("qid").cast("string"), F.col("path"))))
    from .numbering import positions

    return positions(rows, ["h", "path"], ["qid"], "no", 1).drop("h")


def _distinct_paths(paths: Column) -> Column:
    """Path structs with a text, first per text."""
    filled = F.filter(paths, lambda p: F.coalesce(p["full_path"], F.lit("")) != "")
    texts = lambda ps: F.transform(ps, lambda p: p["full_path"])
    return S.let(filled, lambda ps: S.let(texts(ps), lambda ts: F.filter(ps, lambda p, i: F.array_position(ts, p["full_path"]) == i + 1)))


def training_format(samples: DataFrame) -> DataFrame:
    """Nested rows with distinct paths, short ones first."""
    return samples.select("id", "question", "answer", "q_entity", "a_entity", S.sort_paths(_distinct_paths(F.col("paths"))).alias("paths"))


def instruction_rows(samples: DataFrame, n: int | None = None) -> DataFrame:
    """Instruction, question with answers, and the ``n`` shortest path texts (all without it)."""
    texts = F.array_distinct(F.filter(F.transform("paths", lambda p: p["full_path"]), lambda t: F.coalesce(t, F.lit("")) != ""))
    return samples.select("id", F.lit(C.INSTRUCTION).alias("instruction"),
                          F.concat(F.lit("Question: "), F.col("question"), F.lit("\nAnswer: "), S.join_answers(F.col("answer"))).alias("input"),
                          S.sort_path_texts(texts, n).alias("output"))


def compact_rows(samples: DataFrame) -> DataFrame:
    return samples.select("id", "question", S.join_answers(F.col("answer")).alias("answer"),
                          F.transform("paths", lambda p: p["relation_chain"]).alias("relation_chains"),
                          F.transform("paths", lambda p: p["full_path"]).alias("path_strings"))


def question_pattern_pairs(questions: DataFrame, paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """(question, pattern) per path whose pattern is indexed."""
    p = paths.filter(F.size("relations") > 0).select("qid", "path_no", "relations", S.subgraph_id(F.col("relations")).alias("subgraph_id"))
    known = p.join(patterns.select("subgraph_id"), "subgraph_id", "left_semi")
    return questions.filter(F.coalesce("question", F.lit("")) != "").select("qid", "question").join(beside(known), "qid")


def reader_rows(preds: DataFrame, patterns: DataFrame, samples: DataFrame) -> DataFrame:
    """Top predicted pattern with its index entry and the answers."""
    top = first_per(preds.select("qid", "rank", "subgraph_id"), ["qid"], ["rank"])
    cols = [c for c in ("relations", "example_triples") if c in patterns.columns]
    return top.join(patterns.select("subgraph_id", *cols), "subgraph_id").join(beside(samples.select(F.col("id").alias("qid"), "question", "answer")), "qid").drop("rank")


def resolve_patterns(preds: DataFrame, patterns: DataFrame) -> DataFrame:
    """Predicted ids with pattern data, or a stub that says it is not in the index."""
    hit = preds.join(patterns, "subgraph_id", "left")
    out = hit.select("qid", "rank", "subgraph_id", F.coalesce("relations", F.array().cast("array<string>")).alias("relations"),
                     F.coalesce("relation_pattern", "subgraph_id").alias("relation_pattern"), F.coalesce("example_count", F.lit(0).cast("bigint")).alias("example_count"),
                     *([F.slice("example_triples", 1, 3).alias("example_triples")] if "example_triples" in patterns.columns else []),
                     F.when(F.col("example_count").isNull(), F.lit("Pattern not found in index")).alias("note"))
    return out


def encode_paths(paths: DataFrame, entity_vocab: DataFrame, relation_vocab: DataFrame, order: list[str], max_len: int, max_paths: int) -> DataFrame:
    """``(qid, no, entity_ids, relation_ids, length)``: diverse paths cut to ``max_len``, begin and end marks, padding.

    At most ``max_paths`` paths of at most ``max_len`` tokens per question are looked up in the vocabularies.
    """
    from .indexes import encode_tokens
    from .ranking import diverse_paths

    p = diverse_paths(paths, order, max_paths).select("qid", "no", F.slice("entities", 1, max_len).alias("e"), "relations")
    want = F.greatest(F.size("e") - 1, F.lit(0))
    rel = F.slice("relations", F.lit(1), F.least(F.lit(max_len - 1), want))
    p = p.withColumn("r", rel).withColumn("missing", F.greatest(want - F.size("r"), F.lit(0))).drop("relations")
    p = bucketed(p, "qid", placed=True)  # read for each vocabulary and for the rows

    def ids(col: str, vocab: DataFrame, out: str) -> DataFrame:
        rows = encode_tokens(p.select("qid", "no", F.posexplode(col).alias("pos", "token")), vocab, "token", by="qid")
        return rows.groupBy("qid", "no").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "idx"))), lambda x: x["idx"]).alias(out))

    big = lambda n: F.lit(n).cast("bigint")
    none = F.array().cast("array<bigint>")
    rows = p.select("qid", "no", "missing").join(beside(ids("e", entity_vocab, "ei")), ["qid", "no"], "left").join(beside(ids("r", relation_vocab, "ri")), ["qid", "no"], "left")
    bos, eos = C.ENTITY_SPECIALS.index("<BOS>"), C.ENTITY_SPECIALS.index("<EOS>")
    ent = F.concat(F.array(big(bos)), F.coalesce("ei", none), F.array(big(eos)))
    pad = lambda xs, n: F.slice(F.concat(xs, F.array_repeat(big(0), n)), 1, n)
    return rows.select("qid", "no", pad(ent, max_len + 2).alias("entity_ids"), pad(F.coalesce("ri", none), max_len + 1).alias("relation_ids"), F.size(ent).alias("length"))


def encode_triples(triples: DataFrame, relation_vocab: DataFrame, buckets: int = 50000, first: int | None = None) -> DataFrame:
    """Relation id, hashed head and tail, and mask 1 per triple; optionally the first n triples of each graph."""
    from .indexes import encode_tokens

    t = triples if first is None else triples.filter(F.col("triple_idx") < first)
    return encode_tokens(t, relation_vocab, "rel", "relation_id").select(
        "gid", "triple_idx", "relation_id", S.hash_bucket(F.col("subj"), buckets).alias("head_id"), S.hash_bucket(F.col("obj"), buckets).alias("tail_id"), F.lit(1.0).alias("mask"))


def context_rows(questions: DataFrame, ranked: DataFrame, entities: DataFrame, top_paths: int | None = None, with_graph: bool = True,
                 candidates: int | None = None) -> DataFrame:
    """Prompt text per question. ``entities`` is the output of ``path_entities``; paths without entities get no line.

    ``top_paths`` and ``candidates`` bound the paths and the candidates of a prompt; without them all are written.
    """
    best = lambda rows: rows if top_paths is None else rows.filter(F.col("rank") <= top_paths)
    e = best(entities)
    lines = e.groupBy("qid", "rank", "path").agg(F.array_sort(F.collect_list(F.struct("no", "entity"))).alias("s")).select(
        "qid", "rank", F.concat(F.lit("• "), F.col("path"), F.lit(": "), F.array_join(F.transform("s", lambda x: x["entity"]), ", ")).alias("line"))
    if not with_graph:
        lines = best(ranked).select("qid", "rank", F.concat(F.lit("• "), F.col("path")).alias("line"))
    text = lines.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
    once = first_per(e.withColumn("low", F.lower("entity")).select("qid", "low", "entity", "rank", "no"), ["qid", "low"], ["rank", "no"])
    cand = top_per(once, ["qid"], ["rank", F.col("no")], candidates, "k").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("k", "entity"))).alias("c"))
    q = questions.select("qid", "question").join(text, "qid", "left").join(cand, "qid", "left")
    full = F.concat(F.lit("Question: "), F.col("question"), F.lit("\n\nKG paths and entities:\n"),
                    F.coalesce(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("No paths")), F.lit("\n\nCandidates: "),
                    F.array_join(F.transform("c", lambda x: x["entity"]), ", "),
                    F.lit("\n\nSelect ONLY the entity that answers the question.\n\nAnswer:"))
    short = F.concat(F.lit("Question: "), F.col("question"), F.lit("\nAnswer directly:"))
    return q.select("qid", F.when(F.size("c") > 0, full).otherwise(short).alias("prompt"))


def first_path_pairs(questions: DataFrame, paths: DataFrame) -> DataFrame:
    first = first_per(paths.filter(F.size("relations") > 0).select("qid", "path_no", "relations"), ["qid"], ["path_no"])
    return questions.select("qid", "question").join(first.select("qid", "relations"), "qid")


# --- augmentation ----------------------------------------------------------------------------------------------------

def augment_question(q: Column, key: Column, seed: int = 42, drop: float = 0.0, swap: float = 0.0, delete: float = 0.0) -> Column:
    """Word dropout, then one swap, then one deletion, each by its probability; at least one word stays."""
    def step_drop(w):
        kept = F.filter(w, lambda _, i: chance(seed, F.lit("drop"), key, i) > drop)
        return F.when(F.size(kept) > 0, kept).otherwise(w)

    def step_swap(w):
        n = F.size(w)
        i = F.floor(chance(seed, F.lit("i"), key) * n).cast("int")
        j = F.pmod(i + 1 + F.floor(chance(seed, F.lit("j"), key) * (n - 1)).cast("int"), n)
        moved = F.transform(w, lambda x, at: F.when(at == i, F.get(w, j)).when(at == j, F.get(w, i)).otherwise(x))
        return F.when((n >= 2) & (chance(seed, F.lit("swap"), key) < swap), moved).otherwise(w)

    def step_delete(w):
        n = F.size(w)
        at = F.floor(chance(seed, F.lit("at"), key) * n).cast("int")
        return F.when((n > 1) & (chance(seed, F.lit("delete"), key) < delete), F.filter(w, lambda _, i: i != at)).otherwise(w)

    words = S.let(S.let(S.let(S.words(q), step_drop), step_swap), step_delete)
    return F.when(F.size(S.words(q)) == 0, q).otherwise(F.array_join(words, " "))


def drop_paths(paths: DataFrame, probability: float, seed: int = 42) -> DataFrame:
    """Drop paths by chance; a question keeps all of them rather than none."""
    r = paths.withColumn("_keep", chance(seed, "qid", "path_no") > probability)
    some = r.groupBy("qid").agg(F.max("_keep").alias("_some"))
    return r.join(some, "qid").filter(F.col("_keep") | ~F.col("_some")).select(*paths.columns)


def pick_path(paths: DataFrame, seed: int = 42) -> DataFrame:
    """One path per question in seeded order."""
    return first_per(paths.withColumn("_c", chance(seed, "qid", "path_no")), ["qid"], ["_c", "path_no"]).drop("_c")


def replace_question(samples: DataFrame, rephrased: DataFrame) -> DataFrame:
    """``rephrased(id, text)``; a missing text keeps the original."""
    return samples.join(rephrased.select("id", "text"), "id", "left").withColumn("question", F.coalesce("text", "question")).drop("text")
