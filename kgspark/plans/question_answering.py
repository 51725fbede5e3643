"""End-to-end runs put together from the operators: retrieval runs per split and answering by traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import retrieval as J
from ..operators.indexes import build_path_corpus
from ..operators.traversal import follow_path


def answer_by_traversal(starts: DataFrame, paths: DataFrame, triples: DataFrame, gold: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Follow the given paths from the question entities: candidate answers per question and how many of the gold
    answers are among them."""
    found = follow_path(starts, paths, triples, max_hops, max_results=None, resolve=False).select("qid", "entity").distinct()
    per = M.question_entity_overlap(found, gold)
    return per.select("qid", F.col("retrieved").cast("bigint").alias("candidates"), F.col("gold").cast("bigint").alias("answers"),
                      F.round(F.col("common") / F.col("gold"), 6).alias("entity_recall"))


def retrieval_run(questions: DataFrame, train: DataFrame, val: DataFrame | None, gold: DataFrame, k: int, tokenizer: str = "path",
                  text: str = "question") -> tuple[DataFrame, DataFrame]:
    """Corpus of the given splits → search → ranked rows with their paths, and the metrics over all questions with gold."""
    corpus = build_path_corpus(*([train] if val is None else [train, val]))
    ranked = J.bm25_search(questions, J.bm25_index(corpus, tokenizer), k, tokenizer, text).join(corpus, "path_id")
    return ranked, M.retrieval_report(ranked, gold)
