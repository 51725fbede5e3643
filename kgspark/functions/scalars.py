"""Row-level rules on strings and arrays, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

PATH_TYPE = "struct<full_path:string,relation_chain:string,entities:array<string>,relations:array<string>>"
SEP = " -> "


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, also where ``use`` refers to it inside loops over arrays."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(c, F.lit(C.WHITESPACE))


def words(c: Column) -> Column:
    """Split at white space, without empty parts."""
    return F.filter(F.split(c, C.WHITESPACE_RE), lambda w: w != "")


def squeeze(c: Column) -> Column:
    return F.array_join(words(c), " ")


def unique_ratio(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, F.size(F.array_distinct(xs)) / F.size(xs)).otherwise(F.lit(0.0))


# --- paths as text ---------------------------------------------------------------------------------------------------

def path_string(entities: Column, relations: Column) -> Column:
    """``(s) --[r]--> (o)`` per step, steps joined by `` | ``."""
    steps = F.transform(relations, lambda r, i: F.concat(
        F.lit("("), F.get(entities, i), F.lit(") --["), r, F.lit("]--> ("), F.get(entities, i + 1), F.lit(")")))
    return F.array_join(steps, " | ")


def full_path(entities: Column, relations: Column, forward: Column | None = None) -> Column:
    """``(e0) --[r]--> (e1) …``; a step whose ``forward`` flag is false is drawn ``<--[r]--``."""
    def step(r, i):
        right = F.concat(F.lit(" --["), r, F.lit("]--> ("))
        arrow = right if forward is None else F.when(F.get(forward, i), right).otherwise(
            F.concat(F.lit(" <--["), r, F.lit("]-- (")))
        return F.concat(arrow, F.get(entities, i + 1), F.lit(")"))

    return F.concat(F.lit("("), F.get(entities, F.lit(0)), F.lit(")"), F.array_join(F.transform(relations, step), ""))


def arrow_path(entities: Column, relations: Column) -> Column:
    """``E0 --r--> E1 --r2--> E2``."""
    steps = F.transform(relations, lambda r, i: F.concat(F.lit(" --"), r, F.lit("--> "), F.get(entities, i + 1)))
    return F.concat(F.get(entities, F.lit(0)), F.array_join(steps, ""))


def entity_path(entities: Column, relations: Column) -> Column:
    """Interleave ``E0 -> R0 -> E1 …``; without entities the relation chain."""
    n = F.size(relations)
    pairs = F.transform(F.sequence(F.lit(0), n), lambda i: F.filter(
        F.array(F.get(entities, i), F.get(relations, i)), lambda v: v.isNotNull()))
    return F.when(F.coalesce(F.size(entities), F.lit(0)) > 0, F.array_join(F.flatten(pairs), SEP)).otherwise(
        relation_chain(relations))


def relation_chain(relations: Column) -> Column:
    return F.array_join(relations, SEP)


def split_chain(path: Column) -> Column:
    """Relations of a path text, split at the arrow and trimmed."""
    return F.transform(F.split(path, "->"), lambda x: strip(x))


def norm_path(path: Column) -> Column:
    return F.array_join(F.transform(split_chain(path), lambda x: F.lower(x)), SEP)


def path_target(entities: Column, path_text: Column) -> Column:
    """Last entity, else the last bracketed part of the text."""
    in_text = F.try_element_at(F.regexp_extract_all(path_text, F.lit(r"\(([^)]+)\)"), F.lit(1)), F.lit(-1))
    return F.coalesce(F.when(F.size(entities) > 0, F.try_element_at(entities, F.lit(-1))), in_text, F.lit(""))


def parse_relations(relations: Column, chain: Column, path_text: Column) -> Column:
    """The relations field, else the chain, else the bracketed relations of the full text."""
    return F.when(F.coalesce(F.size(relations), F.lit(0)) > 0, relations).when(
        F.coalesce(chain, F.lit("")) != "", F.split(chain, SEP)).otherwise(
        F.coalesce(F.regexp_extract_all(path_text, F.lit(r"--\[([^\]]+)\]-->"), F.lit(1)),
                   F.array().cast("array<string>")))


def entities_of_path(path: Column) -> Column:
    return F.filter(F.split(path, SEP), lambda _, i: i % 2 == 0)


def strip_entities(path: Column) -> Column:
    """Relations of an interleaved path text."""
    return F.filter(F.split(path, SEP), lambda _, i: i % 2 == 1)


def hop_label(relations: Column) -> Column:
    return F.least(F.greatest(F.size(relations), F.lit(1)), F.lit(4))


# --- names and answers -----------------------------------------------------------------------------------------------

def norm_entity(c: Column) -> Column:
    return F.lower(strip(c))


def norm_answer(c: Column, keep_articles: bool = False) -> Column:
    tokens = words(F.translate(F.lower(c), C.PUNCTUATION, ""))
    if not keep_articles:
        tokens = F.filter(tokens, lambda w: ~w.isin(C.ARTICLES))
    return F.array_join(tokens, " ")


def clean_entity(c: Column) -> Column:
    s = F.btrim(strip(c), F.lit("\"'[]"))
    s = F.regexp_replace(s, r"[\s\x0b\x1c-\x1f\x85\p{Z}]*\([^)]*\)[\s\x0b\x1c-\x1f\x85\p{Z}]*$", "")
    return strip(F.rtrim(s, F.lit(".,!")))


def norm_entity_paren(c: Column) -> Column:
    s = F.regexp_replace(F.lower(strip(c)), r"^(the|a|an)[\s\x0b\x1c-\x1f\x85\p{Z}]+", "")
    return strip(F.regexp_replace(s, r"[\s\x0b\x1c-\x1f\x85\p{Z}]*\([^)]*\)", ""))


def relation_matches(a: Column, b: Column) -> Column:
    """Equal, one inside the other, same last dotted part, or a shared key word in both last parts."""
    last_a, last_b = F.substring_index(a, ".", -1), F.substring_index(b, ".", -1)
    low_a, low_b = F.lower(last_a), F.lower(last_b)
    shared = F.exists(F.array(*[F.lit(k) for k in C.RELATION_KEYWORDS]),
                      lambda k: F.contains(low_a, k) & F.contains(low_b, k))
    return F.contains(a, b) | F.contains(b, a) | (last_a == last_b) | shared


def relation_to_text(r: Column) -> Column:
    parts = F.split(r, r"\.")
    spaced = lambda c: F.translate(c, "_", " ")
    return F.when(F.size(parts) >= 3, F.concat(F.get(parts, F.lit(1)), F.lit("'s "), spaced(F.get(parts, F.lit(2))))).when(
        F.size(parts) == 2, spaced(F.get(parts, F.lit(1)))).otherwise(spaced(r))


def chain_to_text(relations: Column) -> Column:
    return F.array_join(F.transform(relations, relation_to_text), SEP)


def pattern_string(relations: Column) -> Column:
    return F.array_join(relations, "|")


def subgraph_id(relations: Column) -> Column:
    flat = F.concat(F.lit("path_"), F.array_join(F.transform(relations, lambda r: F.translate(r, ".", "_")), "_"))
    short = F.concat(F.lit("path_"), F.substring(F.md5(pattern_string(relations)), 1, 8))
    return F.when(F.coalesce(F.size(relations), F.lit(0)) == 0, F.lit("path_empty")).when(
        F.length(flat) > 100, short).otherwise(flat)


# --- questions and generated answers ---------------------------------------------------------------------------------

def preprocess_question(q: Column) -> Column:
    s = F.regexp_replace(F.lower(strip(q)), C.WHITESPACE_RE, " ")
    return F.rtrim(s, F.lit(".!"))


def tokens_path(c: Column) -> Column:
    """Lower case, arrows and underscores become blanks."""
    return words(F.replace(F.replace(F.lower(c), F.lit("->"), F.lit(" ")), F.lit("_"), F.lit(" ")))


def tokens_split(c: Column) -> Column:
    return words(F.lower(c))


def tokens_word(c: Column) -> Column:
    """Runs of letters, digits and underscores, of any script."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0))


TOKENIZERS = {"path": tokens_path, "split": tokens_split, "word": tokens_word}


def clean_answer(c: Column) -> Column:
    """Drop known openings (each once, in order), quotes and the final dot."""
    s = strip(c)
    for prefix in C.ANSWER_PREFIXES:
        hit = F.lower(F.substring(s, 1, len(prefix))) == prefix.lower()
        s = F.when(hit, strip(F.substring(s, len(prefix) + 1, 2147483647))).otherwise(s)
    return strip(F.rtrim(F.btrim(s, F.lit("\"'")), F.lit(".")))


def clean_answer_first_line(c: Column) -> Column:
    s = F.regexp_replace(c, r"(?i)^(The answer is:?|Answer:?)[\s\x0b\x1c-\x1f\x85\p{Z}]*", "")
    s = F.rtrim(strip(F.substring_index(strip(s), "\n", 1)), F.lit("."))
    return F.btrim(s, F.lit("\"'"))


def clean_answer_numbered(c: Column) -> Column:
    s = F.rtrim(F.btrim(strip(c), F.lit("\"'")), F.lit("."))
    for pattern in (r"(?id)^(The answer is|Answer:|Based on.*?,)", r"^[0-9]+\.[\s\x0b\x1c-\x1f\x85\p{Z}]*", r"(?d)\(.*?\)"):
        s = F.regexp_replace(s, pattern, "")
    return strip(s)


def final_answer(c: Column) -> Column:
    """Text after the last ``Final Answer:``, or everything."""
    return F.when(F.contains(c, F.lit("Final Answer:")), strip(F.substring_index(c, "Final Answer:", -1))).otherwise(c)


def map_to_candidates(answer: Column, candidates: Column) -> Column:
    """Each comma part becomes the first candidate equal to it or holding it, else stays."""
    def swap(part):
        p = strip(part)
        n = norm_entity_paren(p)
        hit = F.filter(candidates, lambda cand: F.contains(norm_entity_paren(cand), n))
        return F.coalesce(F.get(hit, F.lit(0)), p)

    return F.when(F.coalesce(F.size(candidates), F.lit(0)) > 0,
                  F.array_join(F.transform(F.split(answer, ","), swap), ", ")).otherwise(answer)


def to_string_list(c: Column, is_array: bool) -> Column:
    """Null becomes an empty list, a scalar a list of one."""
    listed = c.cast("array<string>") if is_array else F.array(c.cast("string"))
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(listed)


def hash_bucket(c: Column, n: int = 50000) -> Column:
    """1 to n by the first 32 bits of the text's md5; null counts as empty."""
    digest = F.md5(F.coalesce(c.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % n + 1).cast("int")


def sparql_mids(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"ns:(m\.[a-zA-Z0-9_]+)"), F.lit(1)))


def join_answers(c: Column) -> Column:
    return F.array_join(c, ", ")


def sort_paths(paths: Column) -> Column:
    """Path structs by number of hops, then text."""
    keyed = F.transform(paths, lambda p: F.struct(F.size(p["relations"]).alias("h"), p["full_path"].alias("t"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda s: s["p"])


def sort_path_texts(texts: Column, n: int | None = None) -> Column:
    """Path texts by number of arrows, then text; the first n (all without it), one per line."""
    keyed = F.transform(texts, lambda t: F.struct((F.size(F.split(t, "-->")) - 1).alias("h"), t.alias("t")))
    listed = F.transform(F.array_sort(keyed), lambda s: s["t"])
    return F.array_join(listed if n is None else F.slice(listed, 1, n), "\n")
