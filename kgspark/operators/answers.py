"""Answer metrics and voting. ``preds(qid, answer)`` has one text per question, ``gold(qid, entity)`` many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import beside


def _pairs(preds: DataFrame, gold: DataFrame) -> DataFrame:
    return preds.select("qid", "answer").join(gold.select("qid", "entity"), "qid")


def _mean(per: DataFrame, col: str) -> DataFrame:
    return per.agg(F.round(F.avg(col), 6).alias(col), F.count(F.lit(1)).alias("questions"))


def answer_scores(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """Per question: exact, lenient, F1 over token sets, and the share of gold texts inside the answer.

    One row per (question, gold answer), reduced by a partial aggregate before it is shuffled again.
    """
    p = preds.select("qid", F.lower("answer").alias("low"), S.norm_answer(F.col("answer")).alias("p"))
    p = p.withColumn("pt", F.array_distinct(S.words(F.col("p"))))
    g = gold.select("qid", F.lower("entity").alias("glow"), S.norm_answer(F.col("entity")).alias("g"))
    g = g.withColumn("gt", F.array_distinct(S.words(F.col("g"))))
    common = F.size(F.array_intersect("pt", "gt"))
    np_, ng = F.size("pt"), F.size("gt")
    f1 = F.when((np_ > 0) & (ng > 0) & (common > 0), 2.0 * (common / np_) * (common / ng) / ((common / np_) + (common / ng))).otherwise(F.lit(0.0))
    filled = (F.col("p") != "") & (F.col("g") != "")
    near = F.contains("p", F.col("g")) | F.contains("g", F.col("p")) | (common >= 0.7 * F.least(np_, ng))
    return p.join(g, "qid").groupBy("qid").agg(
        F.max((F.col("p") == F.col("g")).cast("double")).alias("exact_match"),
        F.max((filled & near).cast("double")).alias("lenient_match"),
        F.max(f1).alias("f1"),
        F.avg(F.contains("low", F.col("glow")).cast("double")).alias("entity_overlap"))


def answer_exact_match(preds, gold) -> DataFrame:
    return _mean(answer_scores(preds, gold).select("exact_match"), "exact_match")


def answer_lenient_match(preds, gold) -> DataFrame:
    return _mean(answer_scores(preds, gold).select("lenient_match"), "lenient_match")


def answer_f1_set(preds, gold) -> DataFrame:
    return _mean(answer_scores(preds, gold).select("f1"), "f1")


def answer_entity_overlap(preds, gold) -> DataFrame:
    return _mean(answer_scores(preds, gold).select("entity_overlap"), "entity_overlap")


def answer_report(preds, gold) -> DataFrame:
    """All four means over questions with a non-empty answer and gold."""
    cols = ["exact_match", "lenient_match", "f1", "entity_overlap"]
    return answer_scores(preds.filter(F.coalesce("answer", F.lit("")) != ""), gold).agg(
        F.count(F.lit(1)).alias("questions"), *[F.round(F.avg(c), 6).alias(c) for c in cols])


def _bag_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection: per distinct common token the smaller number of occurrences."""
    count = lambda xs, t: F.size(F.filter(xs, lambda y: y == t))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, t: n + F.least(count(a, t), count(b, t)))


def answer_f1_bag(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """Per question: best F1 over token multisets among gold texts inside (or around) the answer, and the loose hit."""
    n = lambda c: S.norm_answer(F.col(c), keep_articles=True)
    m = _pairs(preds.withColumn("answer", n("answer")), gold.withColumn("entity", n("entity")))
    m = m.filter(F.contains("answer", F.col("entity")) | F.contains("entity", F.col("answer")))
    m = m.withColumn("wa", S.words(F.col("answer"))).withColumn("wb", S.words(F.col("entity")))
    same = S.let(F.col("wa"), lambda a: S.let(F.col("wb"), lambda b: _bag_overlap(a, b)))
    m = m.withColumn("same", same).withColumn("na", F.size("wa")).withColumn("nb", F.size("wb"))
    pr, rc = F.col("same") / F.col("na"), F.col("same") / F.col("nb")
    f1 = F.when(F.col("answer") == F.col("entity"), F.lit(1.0)).when(F.col("same") > 0, 2.0 * pr * rc / (pr + rc)).otherwise(F.lit(0.0))
    per = m.groupBy("qid").agg(F.max(f1).alias("f1"))
    return preds.select("qid").join(per, "qid", "left").select(
        "qid", F.coalesce("f1", F.lit(0.0)).alias("f1"), (F.coalesce("f1", F.lit(0.0)) > 0.5).cast("int").alias("hit"))


def answer_bag_report(preds, gold) -> DataFrame:
    return answer_f1_bag(preds, gold).agg(F.round(F.avg("f1"), 6).alias("f1"), F.round(F.avg("hit"), 6).alias("hits"))


def context_recall(instantiated: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of questions with gold where a concrete path ``(qid, text)`` holds a normalised gold answer.

    A gold text is sought in the texts of its question, where they lie, until one holds it; for questions with too many such pairs, by its
    rarest gram in an index of the texts.
    """
    from .grams import containment_pairs, crowded, split_groups

    n = lambda df, c: df.select("qid", S.norm_answer(F.col(c), keep_articles=True).alias(f"n_{c}"))
    many = crowded(instantiated, gold, ["qid"])
    (few_texts, many_texts), (few_names, many_names) = split_groups(n(instantiated, "text"), many, ["qid"]), split_groups(n(gold, "entity"), many, ["qid"])
    held = (F.col("qid") == F.col("_qid")) & F.contains("n_text", F.col("n_entity"))
    hit = few_names.join(beside(few_texts.withColumnRenamed("qid", "_qid")), held, "left_semi").select("qid")
    if many is not None:
        hit = hit.unionByName(containment_pairs(many_texts.distinct(), many_names.distinct(), ["qid"], "n_text", "n_entity").select("qid"))
    per = gold.select("qid").distinct().join(beside(hit.distinct().withColumn("ok", F.lit(1.0))), "qid", "left")
    return per.agg(F.round(F.avg(F.coalesce("ok", F.lit(0.0))), 6).alias("context_recall"))


VOTE_NORMS = {
    "plain": lambda c: S.strip(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", "")),
    "lower": lambda c: F.lower(S.strip(c)),
    "squad": lambda c: S.norm_answer(c),
    "none": lambda c: c,
}


def majority_vote(answers: DataFrame, norm: str = "plain") -> DataFrame:
    """``answers(qid, sample_no, answer)`` → most frequent answer (earliest among equals), its first spelling, and the
    share of votes among non-empty answers."""
    votes = answers.filter(F.coalesce("answer", F.lit("")) != "").withColumn("key", VOTE_NORMS[norm](F.col("answer")))
    per = votes.groupBy("qid", "key").agg(F.count(F.lit(1)).alias("votes"), F.min("sample_no").alias("first"),
                                          F.min_by("answer", "sample_no").alias("answer"))
    won = per.groupBy("qid").agg(F.max_by(F.struct("answer", "votes"), F.struct(F.col("votes"), -F.col("first"))).alias("w"),
                                 F.sum("votes").alias("total"))
    return won.select("qid", "w.answer", F.round(F.col("w.votes") / F.col("total"), 6).alias("confidence"))
