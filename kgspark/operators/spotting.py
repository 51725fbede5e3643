"""Entity spotting over question tables: one array expression per rule, one explode, one partial aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import questions as Q
from ..functions import scalars as S
from .entity_match import dictionary_hits, fuzzy_match, phrase_lookup, spellings, vocab_candidates


def extract_entities(questions: DataFrame, vocab: DataFrame | None = None, spans: DataFrame | None = None) -> DataFrame:
    """``questions(qid, question)`` → ``(qid, entity, score)``, the best score per entity.

    ``spans(qid, entity, label)`` are supplied named-entity spans. With ``vocab(token)`` candidates are matched to it and
    gain 0.05.
    """
    text = F.col("question")
    w = C.SPAN_SCORES
    no_stop = lambda xs: F.filter(xs, lambda e: ~F.lower(e).isin(C.STOP_WORDS))
    scored = lambda xs, s: F.transform(xs, lambda e: F.struct(e.alias("entity"), F.lit(s).alias("score")))
    rules = F.concat(
        scored(no_stop(Q.capitalised_runs(text)), w["capitalised"]), scored(dictionary_hits(text, C.DEMONYMS), w["demonym"]),
        scored(no_stop(F.concat(Q.after_preposition(text), Q.possessive_names(text), Q.years(text))), w["pattern"]),
        scored(Q.quoted_phrases(text), w["quoted"]))
    rows = questions.select("qid", F.explode(rules).alias("e")).select("qid", "e.entity", "e.score")
    if spans is not None:
        name = S.strip(F.col("entity"))
        score = F.when(F.col("label").isin(C.SPAN_LABELS), w["named"]).when(F.col("label") == "NOUN_CHUNK", w["chunk"])
        given = spans.select("qid", name.alias("entity"), score.alias("score")).filter(
            F.col("score").isNotNull() & (F.col("entity") != "") & ~F.lower("entity").isin(C.STOP_WORDS))
        rows = rows.unionByName(given)
    best = rows.groupBy("qid", "entity").agg(F.max("score").alias("score"))
    if vocab is None:
        return best
    matched = fuzzy_match(best.select("qid", "entity"), vocab).select("qid", "entity", "match")
    known = vocab_candidates(vocab).select(F.col("token").alias("match")).distinct().withColumn("known", F.lit(0.05))
    out = best.join(matched, ["qid", "entity"]).join(known, "match", "left")
    s = F.least(F.lit(1.0), F.round(F.col("score") + F.coalesce("known", F.lit(0.0)), 6))
    return out.groupBy("qid", F.col("match").alias("entity")).agg(F.max(s).alias("score"))


def extract_entities_fast(questions: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """``(qid, entity)`` from dictionaries, capitals, possessives, years and vocabulary phrases; spelling as in the vocabulary."""
    text = F.col("question")
    no_stop = lambda xs: F.filter(xs, lambda e: ~F.lower(e).isin(C.STOP_WORDS_FAST))
    rules = F.array_distinct(F.concat(
        dictionary_hits(text, C.DEMONYMS_FAST), dictionary_hits(text, C.COMMON_NAMES), no_stop(Q.capitalised_runs(text)),
        no_stop(Q.possessive_names(text)), Q.years(text)))
    rows = questions.select("qid", F.explode(rules).alias("entity"))
    if vocab is None:
        return rows
    spelled = spellings(vocab)
    respelled = rows.withColumn("low", F.lower("entity")).join(spelled, "low", "left").select("qid", F.coalesce("token", "entity").alias("entity"))
    return respelled.unionByName(phrase_lookup(questions, vocab)).distinct()
