"""Places where a user's model joins in: pair scoring and text embedding, in Arrow batches, and SQL names for scalars."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import scalars as S


def score_pairs(ranked: DataFrame, fn: Callable, batch: int = 32, query: str = "question", doc: str = "path") -> DataFrame:
    """``fn(DataFrame[query, doc]) -> Series`` in batches. ``fn`` may be a factory with ``load()``, called once per task."""
    @F.pandas_udf("double")
    def scorer(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = fn.load() if hasattr(fn, "load") else fn
        for q, d in parts:
            pairs = pd.DataFrame({"query": q, "doc": d})
            out = [np.asarray(score(pairs.iloc[i:i + batch]), dtype="float64") for i in range(0, len(pairs), batch)]
            yield pd.Series(np.concatenate(out) if out else np.array([], dtype="float64"))

    return ranked.withColumn("score", scorer(F.col(query), F.col(doc)))


def embed(df: DataFrame, text: str, fn: Callable, batch: int = 256, out: str = "vec") -> DataFrame:
    """``fn(Series) -> ndarray`` in batches; distinct handling of repeats is up to the caller."""
    @F.pandas_udf("array<float>")
    def encoder(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = fn.load() if hasattr(fn, "load") else fn
        for texts in parts:
            rows = []
            for i in range(0, len(texts), batch):
                rows.extend(np.asarray(encode(texts.iloc[i:i + batch]), dtype="float32"))
            yield pd.Series(rows, dtype="object")

    return df.withColumn(out, encoder(F.col(text)))


def _quoted(text: str) -> str:
    """A SQL literal; characters other than letters, digits and blanks by their code."""
    return "'" + "".join(c if c.isascii() and (c.isalnum() or c == " ") else f"\\u{ord(c):04x}" for c in text) + "'"


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Temporary SQL functions whose bodies are expressions, so the optimizer can inline them.

    They are the scalars of the same names, built from the same constants: white space of any kind, punctuation, articles and key words
    are those of ``functions``, and nulls give what they give there.
    """
    blank, blanks, sep = _quoted(C.WHITESPACE), _quoted(C.WHITESPACE_RE), _quoted(S.SEP)
    listed = lambda xs: ", ".join(map(_quoted, xs))
    last = lambda x: f"substring_index({x}, '.', -1)"
    flat = "concat('path_', array_join(transform(rs, r -> translate(r, '.', '_')), '_'))"
    bodies = {
        "kg_norm_path(s STRING)": f"array_join(transform(split(s, '->'), x -> lower(btrim(x, {blank}))), {sep})",
        "kg_norm_answer(s STRING)":
            f"array_join(filter(split(translate(lower(s), {_quoted(C.PUNCTUATION)}, ''), {blanks}), w -> w not in ('', {listed(C.ARTICLES)})), ' ')",
        "kg_relation_matches(a STRING, b STRING)":
            f"contains(a, b) OR contains(b, a) OR {last('a')} = {last('b')} OR "
            f"exists(array({listed(C.RELATION_KEYWORDS)}), k -> contains(lower({last('a')}), k) AND contains(lower({last('b')}), k))",
        "kg_relation_to_text(r STRING)":
            "CASE WHEN size(split(r, '[.]')) >= 3 THEN concat(get(split(r, '[.]'), 1), '\\'s ', translate(get(split(r, '[.]'), 2), '_', ' ')) "
            "WHEN size(split(r, '[.]')) = 2 THEN translate(get(split(r, '[.]'), 1), '_', ' ') ELSE translate(r, '_', ' ') END",
        "kg_subgraph_id(rs ARRAY<STRING>)":
            f"CASE WHEN coalesce(size(rs), 0) = 0 THEN 'path_empty' WHEN length({flat}) > 100 "
            f"THEN concat('path_', substr(md5(array_join(rs, '|')), 1, 8)) ELSE {flat} END",
    }
    kinds = {"kg_relation_matches": "BOOLEAN"}
    names = []
    for head, body in bodies.items():
        name = head.split("(")[0]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kinds.get(name, 'STRING')} RETURN {body}")
        names.append(name)
    return names
