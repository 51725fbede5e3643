"""Text rules over questions, as Column expressions built from the fixed rule lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from . import scalars as S


def _finds(text: Column, pattern: str) -> Column:
    """Search with letters of all scripts as word characters and a dot that stops at line feeds only."""
    return text.rlike("(?Ud)" + pattern)


def _any_word(low: Column, cues: list[str]) -> Column:
    hit = F.lit(False)
    for w in cues:
        hit = hit | F.contains(low, F.lit(w))
    return hit


def classify_question(q: Column) -> Column:
    """STRUCT<qtype, confidence, min_hops, max_hops, reason>: first matching rule, else a count of relation words."""
    return S.let(F.lower(S.strip(q)), _typed)


def _typed(low: Column) -> Column:
    def verdict(qtype: str, confidence, lo: int, hi: int, reason) -> Column:
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(F.lit(qtype).alias("qtype"), as_col(confidence).cast("double").alias("confidence"),
                        F.lit(lo).alias("min_hops"), F.lit(hi).alias("max_hops"), as_col(reason).alias("reason"))

    rules = []
    for qtype, confidence, patterns in (("definitional", 0.85, C.DEFINITIONAL_PATTERNS), ("literal", 0.80, C.LITERAL_PATTERNS),
                                        ("two_hop", 0.75, C.TWO_HOP_PATTERNS)):
        lo, hi = C.HOP_RANGES[qtype]
        name = qtype.replace("_", "-")
        rules += [(_finds(low, p), verdict(qtype, confidence, lo, hi, f"Matched {name} pattern: {p}")) for p in patterns]
    n = F.size(F.filter(F.array(*[F.lit(k) for k in C.ONE_HOP_KEYWORDS]), lambda k: F.contains(low, k)))
    found = verdict("one_hop", F.least(F.lit(0.7), F.round(0.5 + n * 0.1, 6)), 1, 2, F.concat(F.lit("Found "), n.cast("string"), F.lit(" relation keyword(s)")))
    rules.append((n >= 1, found))
    out = F.when(*rules[0])
    for r in rules[1:]:
        out = out.when(*r)
    return out.otherwise(verdict("one_hop", 0.5, 1, 3, "Default classification (no strong patterns matched)"))


def _hop_stats(paths: Column) -> tuple[Column, Column, Column]:
    """Mean and maximum hops over paths that have relations, and whether there is one."""
    n = F.filter(F.transform(F.coalesce(paths, F.array().cast(f"array<{S.PATH_TYPE}>")), lambda p: F.size(p["relations"])), lambda h: h > 0)
    mean = F.aggregate(n, F.lit(0), lambda a, h: a + h) / F.size(n)
    return mean, F.array_max(n), F.size(n) > 0


def infer_type_v1(q: Column, paths: Column) -> Column:
    mean, top, some = _hop_stats(paths)
    low = F.lower(q)
    return F.when(~some, "one_hop").when(_any_word(low, C.LABEL_V1_DEFINITIONAL), "definitional").when(
        _any_word(low, C.LABEL_V1_LITERAL), "literal").when((mean >= 2) | (top >= 3), "two_hop").otherwise("one_hop")


def infer_type_v2(q: Column, paths: Column) -> Column:
    mean, top, some = _hop_stats(paths)
    mean, top = F.when(some, mean).otherwise(F.lit(1.0)), F.when(some, top).otherwise(F.lit(1))
    low = F.lower(q)
    return F.when(_any_word(low, C.LABEL_V2_DEFINITIONAL) & (top <= 1), "definitional").when(
        _any_word(low, C.LABEL_V2_LITERAL), "literal").when((top >= 3) | (mean >= 2), "two_hop").otherwise("one_hop")


def hybrid_type(model: Column, q: Column, threshold: float = 0.7) -> Column:
    """A supplied prediction struct if it is confident enough, else the rules."""
    return F.when(F.coalesce(model["confidence"], F.lit(0.0)) >= threshold, model).otherwise(classify_question(q))


def expand_query(q: Column) -> Column:
    extras = S.let(F.lower(q), lambda low: F.filter(
        F.array(*[F.when(_any_word(low, cues), F.lit(extra)) for cues, extra in C.QUERY_EXPANSIONS]), lambda e: e.isNotNull()))
    return F.array_join(F.concat(F.array(q), extras), " ")


def domain_keywords(q: Column) -> Column:
    return S.let(F.lower(q), lambda low: F.filter(
        F.array(*[F.when(_any_word(low, cues), F.lit(d)) for d, cues in C.DOMAIN_WORDS.items()]), lambda d: d.isNotNull()))


def answer_type_hints(paths: Column, first: int | None = None) -> Column:
    """Kinds of answers the last relations of the ``first`` paths (all without it) announce, distinct, in path order."""
    rules = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in C.ANSWER_TYPES.items()])

    def one(path):
        last = F.lower(S.strip(F.substring_index(path, "->", -1)))
        return S.let(last, lambda low: F.get(F.filter(rules, lambda r: F.contains(low, r["k"])), F.lit(0))["v"])

    return F.array_distinct(F.filter(F.transform(paths if first is None else F.slice(paths, 1, first), one), lambda v: v.isNotNull()))


# --- entity spotting -------------------------------------------------------------------------------------------------

_CAPITALISED = r"(?U)\b([A-Z][a-z]+\b(?:\s+[A-Z][a-z]+\b)*+)"
_AFTER_PREPOSITION = r"(?U)(?:of|in|from|about)\s+(?:the\s+)?([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*+)"
_YEAR = r"(?U)\b(1[0-9]{3}|20[0-9]{2})\b"


def capitalised_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_CAPITALISED), F.lit(1))


def quoted_phrases(text: Column) -> Column:
    return F.concat(F.regexp_extract_all(text, F.lit(r'"([^"]+)"'), F.lit(1)), F.regexp_extract_all(text, F.lit(r"'([^']+)'"), F.lit(1)))


def possessive_names(text: Column) -> Column:
    """Words before ``'s``, each capitalised. The text is cut at ``'s`` and the letters at the end of each piece are
    taken, which needs one pass over the text however long it is."""
    pieces = F.split(text, "'s")
    before = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    tails = F.transform(before, lambda p: F.regexp_replace(p, r"(?s)^.*[^A-Za-z\s]", ""))
    names = F.filter(tails, lambda t: t.rlike(r"[A-Za-z]\z"))
    return F.transform(names, lambda t: F.array_join(F.transform(S.words(t), lambda w: F.initcap(w)), " "))


def years(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_YEAR), F.lit(1))


def after_preposition(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_AFTER_PREPOSITION), F.lit(1))
