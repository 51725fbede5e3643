"""Linking names and texts to entities: equal, normalised and substring matches, dictionaries and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scalars as S
from ..functions.similarity import ascii_norm, signature, similarity
from ..session import cut_lineage
from .adjacency import Adjacency
from .grams import containment_pairs, held_names
from .numbering import first_per


def graph_entities(triples: DataFrame) -> DataFrame:
    """Distinct ``(gid, entity)`` of a triple table."""
    both = triples.select("gid", F.explode(F.array("subj", "obj")).alias("entity"))
    return both.distinct()


def match_entities(names: DataFrame, triples: DataFrame, ways: Adjacency | None = None) -> DataFrame:
    """``names(qid, gid, entity)`` → ``(qid, gid, entity, match)``.

    Equal or normalised-equal graph entities; a name with neither takes every graph entity whose normal form holds it
    or is held by it. The grams for that are made only if there is such a name. ``ways``: the graphs' layout; names that lie with their
    graph are matched there.
    """
    near, keep = (ways.near, ways.keep) if ways is not None else (lambda rows: rows, cut_lineage)
    ents = graph_entities(triples).select("gid", F.col("entity").alias("match"), S.norm_entity(F.col("entity")).alias("norm"))
    wanted = names.select("qid", "gid", "entity", S.norm_entity(F.col("entity")).alias("n")).distinct()
    cols = ["qid", "gid", "entity", "match"]
    # an equal name also has an equal normal form, so one join covers both
    direct = keep(wanted.join(near(ents.withColumnRenamed("norm", "n")), ["gid", "n"]).select(*cols))
    rest = keep(wanted.join(near(direct.select("qid", "gid", "entity").distinct()), ["qid", "gid", "entity"], "left_anti"))
    if rest.isEmpty():
        return direct
    near = ents.join(rest.select("gid").distinct(), "gid", "left_semi")
    inside = containment_pairs(near, rest, ["gid"], "norm", "n").select(*cols)
    around = containment_pairs(rest, near, ["gid"], "n", "norm").select(*cols)
    return direct.unionByName(inside.unionByName(around).distinct())


def resolve_entity(names: DataFrame, triples: DataFrame) -> DataFrame:
    """``names(qid, gid, entity)`` → matches that are equal, else equal in lower case."""
    ents = graph_entities(triples).select("gid", F.col("entity").alias("match"), F.lower("entity").alias("low"))
    hits = names.select("qid", "gid", "entity", F.lower("entity").alias("low")).distinct().join(ents, ["gid", "low"])
    found = hits.groupBy("qid", "gid", "entity").agg(F.max(F.col("match") == F.col("entity")).alias("exact"), F.collect_set("match").alias("all"))
    return found.select("qid", "gid", "entity", F.explode(F.when(F.col("exact"), F.array("entity")).otherwise(F.col("all"))).alias("match"))


def dictionary_hits(text: Column, entries: dict[str, str]) -> Column:
    """Entities whose key occurs in the lower-cased text, as an array. The dictionary is part of the expression."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in entries.items()])
    hits = S.let(F.lower(text), lambda low: F.filter(pairs, lambda p: F.contains(low, p["k"])))
    return F.array_distinct(F.transform(hits, lambda p: p["v"]))


def keyword_dictionary_match(questions: DataFrame, entries: dict[str, str]) -> DataFrame:
    return questions.select("qid", F.explode(dictionary_hits(F.col("question"), entries)).alias("entity"))


def dictionary_table_match(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """``(qid, entity)``: as ``keyword_dictionary_match``, with a table ``entries(key, entity)`` of any size.

    Texts are read in place for each key's rarest gram (see ``held_names``); keys too many for that meet the lower-cased texts in a gram index.
    Null texts, keys and entities give nothing; an empty key occurs in every text.
    """
    low = questions.select("qid", F.lower("question").alias("low")).filter("low is not null")
    known = entries.select("key", "entity").filter("key is not null and entity is not null").distinct()
    held = held_names(low.select(F.col("qid").alias("id"), F.col("low").alias("text")), known.select(F.col("key").alias("name")).distinct())
    if held is not None:
        return held.select(F.col("id").alias("qid"), F.col("name").alias("key")).join(known, "key").select("qid", "entity").distinct()
    texts = low.select("low").distinct()
    found = cut_lineage(containment_pairs(texts, known, [], "low", "key").select("low", "entity").distinct())
    return low.join(found, "low").select("qid", "entity").distinct()


def vocab_candidates(vocab: DataFrame, token: str = "token") -> DataFrame:
    """Drop specials, bracketed tokens and relation names from a vocabulary."""
    t = F.col(token)
    return vocab.filter(~t.startswith("[") & ~t.startswith("<") & ~t.rlike(r"^[a-z_]+\.[a-z_]+\."))


def spellings(vocab: DataFrame) -> DataFrame:
    """``(low, token)``: the last spelling of every candidate of a vocabulary, by its lower-cased form. Written out, so that
    a join knows its size, and texts stay where they are beside a small vocabulary."""
    return cut_lineage(vocab_candidates(vocab).groupBy(F.lower("token").alias("low")).agg(F.max("token").alias("token")))


def question_phrases(text: Column) -> Column:
    """Runs of two to four words of the lower-cased text, and single words longer than two that are no stop words."""
    def phrases(w):
        n = F.size(w)

        def runs(k):
            cut = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
            return F.when(n >= k, cut).otherwise(F.array().cast("array<string>"))

        single = F.filter(w, lambda x: (F.length(x) > 2) & ~x.isin(C.STOP_WORDS_FAST))
        return F.concat(runs(4), runs(3), runs(2), single)

    return F.array_distinct(S.let(S.words(F.lower(text)), phrases))


def phrase_lookup(questions: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(qid, entity)``: phrases that equal a vocabulary entry, ignoring case. The last spelling of a form counts."""
    phrases = questions.select("qid", F.explode(question_phrases(F.col("question"))).alias("low"))
    spelled = spellings(vocab).withColumnRenamed("token", "entity")
    return phrases.join(spelled, "low").select("qid", "entity").distinct()


def fuzzy_match(candidates: DataFrame, vocab: DataFrame, threshold: float = 80.0) -> DataFrame:
    """``candidates(qid, entity)`` → ``(qid, entity, match, score)``.

    Equal normal form first; else the most similar entry that shares a word longer than two letters; below the
    threshold the candidate itself. A text is compared once, whatever number of questions name it.

    Pairs meet on a shared word and the entry's length: a word that half of all entries have is dealt over as many keys as there are
    lengths within reach, and a pair becomes a row only if so few characters of either are without a partner that the threshold can be met.
    """
    entries = vocab_candidates(vocab).select(F.col("token").alias("entry")).distinct()
    forms = entries.withColumn("norm", ascii_norm(F.col("entry")))
    spelled = forms.groupBy("norm").agg(F.max("entry").alias("match"))
    texts = candidates.select("entity").distinct().withColumn("norm", ascii_norm(F.col("entity")))
    equal = cut_lineage(texts.join(spelled, "norm").select("entity", "match", F.lit(100.0).alias("score")))
    rest = texts.join(equal.select("entity"), "entity", "left_anti")
    long = lambda c: F.explode(F.array_distinct(F.filter(S.words(c), lambda x: F.length(x) > 2)))
    by_word = entries.select("entry", F.length("entry").alias("size"), signature(F.col("entry")).alias("entry_set"), long(F.lower("entry")).alias("word"))
    # a score of t needs min(len) >= t/(200-t) * max(len)
    n, t = F.length("entity"), threshold
    low, high = F.ceil(n * t / (200 - t)).cast("int"), F.floor(n * (200 - t) / t).cast("int")
    own = rest.select("entity", n.alias("n"), signature(F.col("entity")).alias("own_set"), F.sequence(low, F.greatest(low, high)).alias("sizes"), long(F.col("norm")).alias("word"))
    own = own.select("entity", "n", "own_set", "word", F.explode("sizes").alias("size"))
    a, b = own.alias("a"), by_word.alias("b")
    both = F.ceil((F.col("a.n") + F.col("b.size")) * F.lit(threshold) / 200)  # characters that have to be common
    missing = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y))))
    hopeful = (missing("a.own_set", "b.entry_set") <= F.col("a.n") - both) & (missing("b.entry_set", "a.own_set") <= F.col("b.size") - both)
    pairs = a.join(b, (F.col("a.word") == F.col("b.word")) & (F.col("a.size") == F.col("b.size")) & hopeful).select("entity", "entry").distinct()
    scored = pairs.withColumn("score", similarity(F.col("entity"), F.col("entry"))).filter(F.col("score") >= threshold)
    best = first_per(scored, ["entity"], [-F.col("score"), F.col("entry")]).select(
        "entity", F.col("entry").alias("match"), "score")
    found = equal.unionByName(best)
    return candidates.join(found, "entity", "left").select(
        "qid", "entity", F.coalesce("match", "entity").alias("match"), "score")
