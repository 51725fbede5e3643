"""Queries for scalar functions and text rules, over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import questions as Q
from ..functions import scalars as S
from ..functions.similarity import ascii_norm
from ..operators import entity_match as M
from ..operators import filters as B
from ..operators import indexes as I
from ..operators import spotting as E
from ..plans import canonical as K
from .core import query, with_tables

WS = "[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+"
PUNCT = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"
words_sql = lambda c: f"list_filter(regexp_split_to_array({c}, '{WS}'), lambda w: w <> '')"
strip_sql = lambda c: f"regexp_replace(regexp_replace({c}, '^{WS}', ''), '{WS}$', '')"
# letters and digits outside ASCII stand as "_" for the SQL engine, whose word class is ASCII only
plain_sql = lambda c: f"regexp_replace({c}, '[^\\x00-\\x7F\\p{{Z}}\\p{{P}}\\p{{S}}\\p{{C}}\\p{{M}}]', '_', 'g')"
lits = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
docs = lambda s, d: K.spread(K.table(s, d, "documents")).select(F.col("doc_id").alias("qid"), F.col("text").alias("question"))
turns = lambda s, d: K.table(s, d, "conversations").select("conv_id", "turn", "text")


def scalar(name, table, key, expr, sql_expr):
    """One function over a whole text column."""
    @query(name, f"select {key}, {sql_expr} out from {table}")
    def _(s, d):
        return K.spread(K.table(s, d, table)).select(key, expr(F.col("text") if table == "documents" else None).alias("out"))


_no_punct = f"translate(lower(text), {PUNCT}, '')"
_ws_star = WS[:-1] + "*"


def paren_sql(c):
    return strip_sql(f"regexp_replace(regexp_replace(lower({strip_sql(c)}), '^(the|a|an){WS}', ''), '{_ws_star}\\([^)]*\\)', '', 'g')")


_arrows = "replace(replace(lower(text), '->', ' '), '_', ' ')"


def doc(name, expr, sql):
    """One function over the whole document texts."""
    scalar(name, "documents", "doc_id", expr, sql)


doc("norm_answer", lambda T: S.norm_answer(T), f"array_to_string(list_filter({words_sql(_no_punct)}, lambda w: w not in ('a', 'an', 'the')), ' ')")
doc("norm_answer_with_articles", lambda T: S.norm_answer(T, True), f"array_to_string({words_sql(_no_punct)}, ' ')")
doc("norm_entity", lambda T: S.norm_entity(T), f"lower({strip_sql('text')})")
doc("norm_entity_paren", lambda T: S.norm_entity_paren(T), paren_sql("text"))
doc("clean_entity", lambda T: S.clean_entity(F.concat(F.lit(' "['), T, F.lit("] (note)  "))),
    strip_sql(f"rtrim(regexp_replace(trim('\"[' || text || '] (note)', '\"''[]'), '{_ws_star}\\([^)]*\\){_ws_star}$', ''), '.,!')"))
doc("preprocess_question", lambda T: S.preprocess_question(T), f"rtrim(regexp_replace(lower({strip_sql('text')}), '{WS}', ' ', 'g'), '.!')")
doc("tokens_path", lambda T: F.array_join(S.tokens_path(T), "|"), f"array_to_string({words_sql(_arrows)}, '|')")
doc("tokens_split", lambda T: F.array_join(S.tokens_split(T), "|"), f"array_to_string({words_sql('lower(text)')}, '|')")
doc("tokens_word", lambda T: F.array_join(S.tokens_word(T), "|"), "array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+'), '|')")
doc("clean_answer", lambda T: S.clean_answer(F.concat(F.lit("  the answer is Answer: '"), T, F.lit("'..  "))),
    strip_sql("rtrim(trim('''' || text || '''..', '\"'''), '.')"))
doc("clean_answer_first_line", lambda T: S.clean_answer_first_line(F.concat(F.lit("THE ANSWER IS:  "), T)),
    "trim(rtrim(" + strip_sql("string_split(" + strip_sql("text") + ", chr(10))[1]") + ", '.'), '\"''')")
doc("clean_answer_numbered", lambda T: S.clean_answer_numbered(F.concat(F.lit("1. "), T)),
    strip_sql("regexp_replace(regexp_replace(rtrim(trim(" + strip_sql("'1. ' || text") + ", '\"'''), '.'), '^1\\." + _ws_star + "', ''), '\\([^\\n]*?\\)', '', 'g')"))
doc("final_answer", lambda T: S.final_answer(F.concat(F.lit("Final Answer: x Final Answer: "), T)), strip_sql("text"))
doc("map_to_candidates", lambda T: S.map_to_candidates(T, F.array(F.lit("The Le (x)"), F.lit("Une"))),
    f"array_to_string(list_transform(string_split(text, ','), lambda p: case when contains('le', {paren_sql('p')}) then 'The Le (x)' when contains('une', {paren_sql('p')}) then 'Une' else {strip_sql('p')} end), ', ')")
scalar("sparql_mids", "pages", "page_id", lambda _: F.array_join(S.sparql_mids(F.regexp_replace("html", "<(/?[a-z0-9]+)", "ns:m.$1")), "|"),
       "(select string_agg(v, '|' order by i) from (select v, min(i) i from (select unnest(l) v, unnest(range(len(l))) i from (select regexp_extract_all(regexp_replace(html, '<(/?[a-z0-9]+)', 'ns:m.\\1', 'g'), 'ns:(m\\.[a-zA-Z0-9_]+)', 1) l) a) b group by v) c)")


def path_rule(name, expr, sql_expr):
    @query(name, with_tables("paths", body=f"select qid, path_no, {sql_expr} out from paths"))
    def _(s, d):
        return K.paths(s, d).select("qid", F.col("path_no").cast("bigint").alias("path_no"),
                                     expr(F.col("entities"), F.col("relations"), F.col("full_path")).alias("out"))


_idx = "range(1, len(relations) + 1)"
path_rule("path_string", lambda E_, R_, FP: S.path_string(E_, R_), f"array_to_string(list_transform({_idx}, lambda i: '(' || entities[i] || ') --[' || relations[i] || ']--> (' || entities[i + 1] || ')'), ' | ')")
path_rule("full_path", lambda E_, R_, FP: S.full_path(E_, R_, F.transform(R_, lambda r, i: i % 2 == 0)),
          f"'(' || entities[1] || ')' || array_to_string(list_transform({_idx}, lambda i: case when i % 2 = 1 then ' --[' || relations[i] || ']--> (' else ' <--[' || relations[i] || ']-- (' end || entities[i + 1] || ')'), '')")
path_rule("arrow_path", lambda E_, R_, FP: S.arrow_path(E_, R_), f"entities[1] || array_to_string(list_transform({_idx}, lambda i: ' --' || relations[i] || '--> ' || entities[i + 1]), '')")
path_rule("entity_path", lambda E_, R_, FP: S.entity_path(E_, R_), f"entities[1] || array_to_string(list_transform({_idx}, lambda i: ' -> ' || relations[i] || ' -> ' || entities[i + 1]), '')")
path_rule("relation_chain", lambda E_, R_, FP: S.relation_chain(R_), "array_to_string(relations, ' -> ')")
path_rule("norm_path", lambda E_, R_, FP: S.norm_path(F.concat(F.lit(" X "), F.replace(F.upper("relation_chain"), F.lit(" -> "), F.lit("->")))), "'x ' || array_to_string(relations, ' -> ')")
path_rule("path_target", lambda E_, R_, FP: S.path_target(F.when(F.col("path_no") % 2 == 0, E_), FP), "entities[-1]")
path_rule("parse_relations", lambda E_, R_, FP: F.array_join(S.parse_relations(F.when(F.col("path_no") % 3 == 0, R_), F.when(F.col("path_no") % 3 == 1, F.col("relation_chain")), FP), "|"), "array_to_string(relations, '|')")
path_rule("entities_of_path", lambda E_, R_, FP: F.array_join(S.entities_of_path(S.entity_path(E_, R_)), "|"), "array_to_string(entities, '|')")
path_rule("strip_entities", lambda E_, R_, FP: F.array_join(S.strip_entities(S.entity_path(E_, R_)), "|"), "array_to_string(relations, '|')")
path_rule("hop_label", lambda E_, R_, FP: S.hop_label(R_), "cast(least(greatest(len(relations), 1), 4) as integer)")
path_rule("relation_to_text", lambda E_, R_, FP: S.relation_to_text(F.array_join(F.slice(F.split(F.get(R_, F.lit(0)), r"\."), 1, F.col("path_no") % 3 + 1), ".")),
          "case path_no % 3 when 0 then string_split(relations[1], '.')[1] when 1 then string_split(relations[1], '.')[2] else string_split(relations[1], '.')[2] || '''s ' || string_split(relations[1], '.')[3] end")
path_rule("chain_to_text", lambda E_, R_, FP: S.chain_to_text(R_), "array_to_string(list_transform(relations, lambda r: string_split(r, '.')[2] || '''s ' || replace(string_split(r, '.')[3], '_', ' ')), ' -> ')")
path_rule("pattern_string", lambda E_, R_, FP: S.pattern_string(R_), "array_to_string(relations, '|')")
path_rule("subgraph_id", lambda E_, R_, FP: S.subgraph_id(F.concat(R_, E_, R_)),
          "case when len('path_' || array_to_string(list_transform(list_concat(relations, entities, relations), lambda r: replace(r, '.', '_')), '_')) > 100 then 'path_' || left(md5(array_to_string(list_concat(relations, entities, relations), '|')), 8) else 'path_' || array_to_string(list_transform(list_concat(relations, entities, relations), lambda r: replace(r, '.', '_')), '_') end")
path_rule("relation_matches", lambda E_, R_, FP: S.relation_matches(F.get(R_, F.lit(0)), F.lit("person.birth.customer")), "relations[1] = 'order.order.customer'")
path_rule("hash_bucket_range", lambda E_, R_, FP: (S.hash_bucket(F.get(E_, F.lit(0))).between(1, 50000)), "true")


@query("hash_bucket", with_tables("paths", body="select qid, path_no, cast(('0x' || left(md5(entities[1]), 8))::bigint % 50000 + 1 as integer) as out from paths"))
def _(s, d):
    return K.paths(s, d).select("qid", "path_no", S.hash_bucket(F.get("entities", F.lit(0))).alias("out")).withColumn("path_no", F.col("path_no").cast("bigint"))


@query("sort_paths", with_tables("paths", body="select qid id, string_agg(full_path, chr(10) order by len(relations), full_path) out from paths group by qid"))
def _(s, d):
    return K.samples(s, d).filter(F.size("paths") > 0).select("id", F.array_join(F.transform(S.sort_paths(F.col("paths")), lambda p: p["full_path"]), "\n").alias("out"))


@query("sort_path_texts", with_tables("paths", body="select qid id, string_agg(full_path, chr(10) order by len(relations), full_path) out from (select *, row_number() over (partition by qid order by len(relations), full_path) k from paths) x where k <= 10 group by qid"))
def _(s, d):
    return K.samples(s, d).filter(F.size("paths") > 0).select("id", S.sort_path_texts(F.transform("paths", lambda p: p["full_path"]), 10).alias("out"))


@query("join_answers", with_tables("a_entities", body="select qid id, string_agg(entity, ', ' order by pos) out from a_entities group by qid"))
def _(s, d):
    return K.samples(s, d).filter(F.size("answer") > 0).select("id", S.join_answers(F.col("answer")).alias("out"))


@query("to_string_list", "select event_id, 1 n, cast(value as varchar) is not null filled from events")
def _(s, d):
    v = S.to_string_list(F.col("value"), False)
    return K.table(s, d, "events").select("event_id", F.size(v).alias("n"), (F.get(v, F.lit(0)) != "").alias("filled"))


def ascii_sql(c):
    """The folding for texts whose accents are all that decomposes, as in the tables at hand."""
    flat = f"regexp_replace(strip_accents(lower({c})), '[^A-Za-z0-9_ \\t\\n\\r\\f\\v\\x1c-\\x1f]', '', 'g')"
    return f"trim(regexp_replace({flat}, '[ \\t\\n\\r\\f\\v\\x1c-\\x1f]+', ' ', 'g'))"


@query("norm_entity_ascii", f"select doc_id, {ascii_sql('text')} as out from documents")
def _(s, d):
    return K.table(s, d, "documents").select("doc_id", ascii_norm(F.col("text")).alias("out"))


# --- question rules ---

def _bounded(p):
    """The same search for an engine whose word class is ASCII only."""
    left, right = p.startswith("\\b"), p.endswith("\\b")
    core = p[2:] if left else p
    core = core[:-2] if right else core
    return ("(^|[^\\p{L}\\p{N}\\p{M}_])" if left else "") + core + ("($|[^\\p{L}\\p{N}\\p{M}_])" if right else "")


_q = lambda s: "'" + s.replace("'", "''") + "'"
_rules = [(t, p, c) for t, c, ps in (("definitional", 0.85, C.DEFINITIONAL_PATTERNS), ("literal", 0.8, C.LITERAL_PATTERNS), ("two_hop", 0.75, C.TWO_HOP_PATTERNS)) for p in ps]
_case = lambda pick, other: "case " + " ".join(f"when regexp_matches(low, {_q(_bounded(p))}) then {pick(t, p, c)}" for t, p, c in _rules) + f" when n >= 1 then {other[0]} else {other[1]} end"
_CLASS = f"""select qid, {_case(lambda t, p, c: _q(t), ("'one_hop'", "'one_hop'"))} qtype, {_case(lambda t, p, c: c, ('least(0.7, 0.5 + n * 0.1)', '0.5'))}::double confidence,
  {_case(lambda t, p, c: C.HOP_RANGES[t][0], (1, 1))} min_hops, {_case(lambda t, p, c: C.HOP_RANGES[t][1], (2, 3))} max_hops,
  {_case(lambda t, p, c: _q(f"Matched {t.replace('_', '-')} pattern: {p}"), ("'Found ' || n || ' relation keyword(s)'", "'Default classification (no strong patterns matched)'"))} reason
  from (select qid, lower({strip_sql('text')}) low, len(list_filter({lits(C.ONE_HOP_KEYWORDS)}, lambda k: contains(lower({strip_sql('text')}), k))) n from src) x"""
_ALL_TEXT = "with src as (select doc_id qid, text from documents union all select 1000000000 + item_id, text from benchmark union all select 2000000000 + conv_id * 1000 + turn, text from conversations union all select 3000000000 + o_orderkey, text from o)"
_O = with_tables("questions", body="select qid o_orderkey, question text from questions")
ALL_TEXT = _ALL_TEXT.replace("with src", f"with o as ({_O}), src")


def all_texts(s, d):
    t = lambda name: K.table(s, d, name)
    rows = t("documents").select(F.col("doc_id").alias("qid"), F.col("text").alias("question"))
    for more in (t("benchmark").select(F.lit(1000000000) + F.col("item_id"), "text"),
                 t("conversations").select(F.lit(2000000000) + F.col("conv_id") * 1000 + F.col("turn"), "text"),
                 K.questions(s, d).select(F.lit(3000000000) + F.col("qid"), "question")):
        rows = rows.union(more)
    return rows.repartition(max(s.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))  # long and short texts mixed


@query("classify_question", f"{ALL_TEXT} {_CLASS}")
def _(s, d):
    return all_texts(s, d).select("qid", Q.classify_question(F.col("question")).alias("c")).select("qid", "c.*")


@query("hybrid_type", f"{ALL_TEXT} select qid, case when qid % 2 = 0 then 'two_hop' else qtype end qtype from ({_CLASS}) y")
def _(s, d):
    t = all_texts(s, d)
    model = F.struct(F.lit("two_hop").alias("qtype"), F.when(F.col("qid") % 2 == 0, 0.9).otherwise(0.4).alias("confidence"), F.lit(2).alias("min_hops"), F.lit(5).alias("max_hops"), F.lit("model").alias("reason"))
    return t.select("qid", Q.hybrid_type(model, F.col("question"))["qtype"].alias("qtype"))


def _any(cues, c="low"):
    return "(" + " or ".join(f"contains({c}, {_q(w)})" for w in cues) + ")"


_HOPS = "select s.qid, lower(question) low, avg(len(relations)) mean, max(len(relations)) top from questions s left join paths p on p.qid = s.qid group by 1, 2"


@query("infer_type_v1", with_tables("questions", "paths", h=_HOPS, body=f"select qid id, case when top is null then 'one_hop' when {_any(C.LABEL_V1_DEFINITIONAL)} then 'definitional' when {_any(C.LABEL_V1_LITERAL)} then 'literal' when mean >= 2 or top >= 3 then 'two_hop' else 'one_hop' end qtype from h"))
def _(s, d):
    return K.samples(s, d).select("id", Q.infer_type_v1(F.col("question"), F.col("paths")).alias("qtype"))


@query("infer_type_v2", with_tables("questions", "paths", h=_HOPS, body=f"select qid id, case when {_any(C.LABEL_V2_DEFINITIONAL)} and coalesce(top, 1) <= 1 then 'definitional' when {_any(C.LABEL_V2_LITERAL)} then 'literal' when coalesce(top, 1) >= 3 or coalesce(mean, 1) >= 2 then 'two_hop' else 'one_hop' end qtype from h"))
def _(s, d):
    return K.samples(s, d).select("id", Q.infer_type_v2(F.col("question"), F.col("paths")).alias("qtype"))


@query("expand_query", f"{ALL_TEXT} select qid, concat_ws(' ', text, " + ", ".join(f"case when {_any(c, 'lower(text)')} then {_q(e)} end" for c, e in C.QUERY_EXPANSIONS) + ") out from src")
def _(s, d):
    return all_texts(s, d).select("qid", Q.expand_query(F.col("question")).alias("out"))


@query("domain_keywords", f"{ALL_TEXT} select qid, concat_ws('|', " + ", ".join(f"case when {_any(c, 'lower(text)')} then {_q(e)} end" for e, c in C.DOMAIN_WORDS.items()) + ") out from src")
def _(s, d):
    return all_texts(s, d).select("qid", F.array_join(Q.domain_keywords(F.col("question")), "|").alias("out"))


@query("answer_type_hints", with_tables("ranked", body="""select qid, coalesce(string_agg(v, '|' order by m) filter (where v is not null), '') out from (
  select qid, case when x like '%region' then 'place/location' when x like '%customer' then 'currency' end v, min(rank) m
  from (select qid, rank, string_split(path, ' -> ')[-1] x from ranked where rank <= 5) a group by 1, 2) r group by qid"""))
def _(s, d):
    p = F.replace(F.replace("path", F.lit("nation.region"), F.lit("nation.location.region")), F.lit("order.customer"), F.lit("order.currency.customer"))
    lists = K.ranked(s, d).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", p.alias("p")))).alias("l"))  # eight paths per question
    return lists.select("qid", F.array_join(Q.answer_type_hints(F.transform("l", lambda x: x["p"]), 5), "|").alias("out"))


_P = plain_sql("text")
_CAP = "regexp_extract_all(pt, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)\\b', 1)"
_OF = "regexp_extract_all(pt, '(?:of|in|from|about)\\s+(?:the\\s+)?([A-Z][a-zA-Z]+(?:\\s+[A-Z][a-zA-Z]+)*)', 1)"
_POSS = "list_transform(regexp_extract_all(text, '([A-Za-z]+(?:\\s+[A-Za-z]+)*)''s', 1), lambda m: array_to_string(list_transform(" + words_sql("m") + ", lambda w: upper(w[1]) || lower(w[2:])), ' '))"
_YEARS = "regexp_extract_all(pt, '\\b(1\\d{3}|20\\d{2})\\b', 1)"
_dict = lambda dd, c="lower(text)": "list_filter([" + ", ".join(f"case when contains({c}, {_q(k)}) then {_q(v)} end" for k, v in dd.items()) + "], lambda x: x is not null)"
_nostop = lambda l, stop: f"list_filter({l}, lambda e: not list_contains({lits(stop)}, lower(e)))"


_SCORED = f"""
  select qid, unnest({_nostop(_CAP, C.STOP_WORDS)}) entity, 0.8 score from b union all select qid, unnest({_dict(C.DEMONYMS)}), 0.85 from b
  union all select qid, unnest({_nostop(f'list_concat({_OF}, {_POSS}, {_YEARS})', C.STOP_WORDS)}), 0.75 from b
  union all select qid, unnest(list_concat(regexp_extract_all(text, '"([^"]+)"', 1), regexp_extract_all(text, '''([^'']+)''', 1))), 0.9 from b"""


@query("extract_entities", f"""{ALL_TEXT}, b as (select qid, text, {_P} pt from src), e as ({_SCORED})
  select qid, entity, max(score)::double score from e group by 1, 2""")
def _(s, d):
    return E.extract_entities(all_texts(s, d))


_FAST = f"select distinct qid, unnest(list_concat({_dict(C.DEMONYMS_FAST)}, {_dict(C.COMMON_NAMES)}, {_nostop(_CAP, C.STOP_WORDS_FAST)}, {_nostop(_POSS, C.STOP_WORDS_FAST)}, {_YEARS})) entity from b"


@query("extract_entities_fast", f"""{ALL_TEXT}, b as (select qid, text, {_P} pt from src)
  {_FAST}""")
def _(s, d):
    return E.extract_entities_fast(all_texts(s, d))


def vocab(s, d):
    """Entries taken from the part names, cities of birth of the words: every distinct word and pair of the benchmark."""
    w = S.words(F.col("text"))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 2, F.lit(0))), lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1)))
    return K.table(s, d, "benchmark").select(F.explode(F.concat(w, pairs)).alias("token")).filter("token is not null").distinct()


_W = words_sql("text")
VOCAB = f"vocab as (select distinct t as token from (select unnest(list_concat(w, case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else [] end)) t from (select {_W} w from benchmark) a) b)"
_CAND = "cand as (select lower(token) low, max(token) entity from vocab where not starts_with(token, '[') and not starts_with(token, '<') and not regexp_matches(token, '^[a-z_]+\\.[a-z_]+\\.') group by 1)"


@query("vocab_candidates", f"with {VOCAB} select token from vocab where not starts_with(token, '[') and not starts_with(token, '<') and not regexp_matches(token, '^[a-z_]+\\.[a-z_]+\\.')")
def _(s, d):
    return M.vocab_candidates(vocab(s, d))


@query("phrase_lookup", f"""with {VOCAB}, {_CAND}, w as (select doc_id qid, {words_sql('lower(text)')} w from documents),
  ph as (select qid, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) low from w union select qid, unnest(list_filter(w, lambda x: len(x) > 2 and not list_contains({lits(C.STOP_WORDS_FAST)}, x))) from w)
  select distinct qid, entity from ph join cand using (low)""")
def _(s, d):
    return M.phrase_lookup(docs(s, d), vocab(s, d))


@query("extract_entities_fast_vocabulary", f"""{ALL_TEXT}, b as (select qid, text, {_P} pt from src), r as ({_FAST}), {VOCAB}, {_CAND}, w as (select qid, {words_sql('lower(text)')} w from src),
  ph as (select qid, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) low from w union select qid, unnest(list_filter(w, lambda x: len(x) > 2 and not list_contains({lits(C.STOP_WORDS_FAST)}, x))) from w)
  select r.qid, coalesce(cand.entity, r.entity) entity from r left join cand on low = lower(r.entity) union select qid, cand.entity from ph join cand using (low)""")
def _(s, d):
    return E.extract_entities_fast(all_texts(s, d), vocab(s, d))


@query("keyword_dictionary_match", f"{ALL_TEXT} select distinct qid, unnest({_dict(C.DEMONYMS)}) entity from src")
def _(s, d):
    return M.keyword_dictionary_match(all_texts(s, d), C.DEMONYMS)


_PAIRS = "dictionary as (select distinct lower(token) as key, token entity from vocab where contains(token, ' '))"


@query("dictionary_table_match", f"with {VOCAB}, {_PAIRS}, t as (select doc_id qid, lower(text) low from documents) select distinct qid, entity from t join dictionary on contains(low, key)")
def _(s, d):
    """The word pairs of the benchmark as a dictionary of names."""
    names = vocab(s, d).filter(F.contains("token", F.lit(" "))).select(F.lower("token").alias("key"), F.col("token").alias("entity"))
    return M.dictionary_table_match(docs(s, d), names)


def fuzzy_sql(asked, threshold=80):
    """CTEs from ``asked(qid, entity)`` to ``matched(entity, match, score)``; the common subsequence as rows of the textbook table."""
    return f"""recursive {VOCAB}, {asked}, ent as (select token entry, {ascii_sql('token')} norm from vocab
      where not starts_with(token, '[') and not starts_with(token, '<') and not regexp_matches(token, '^[a-z_]+\\.[a-z_]+\\.')),
    txt as (select distinct entity, {ascii_sql('entity')} norm from asked),
    eq as (select entity, max(entry) as match, 100.0::double score from txt join ent using (norm) group by 1),
    meet as (select distinct entity, entry from (select entity, unnest({words_sql('norm')}) word from txt where entity not in (select entity from eq)) a
      join (select entry, unnest({words_sql('lower(entry)')}) word from ent) b using (word)
      where len(word) > 2 and least(len(entity), len(entry)) * (200 - {threshold}) >= greatest(len(entity), len(entry)) * {threshold}),
    lcs as (select entity, entry, 0 i, list_transform(range(len(entity) + 1), lambda x: 0) r from meet
      union all select entity, entry, i + 1, list_prepend(0, list_transform(range(1, len(q) + 1), lambda k: list_max(q[1:k]))) from (
        select entity, entry, i, list_transform(range(1, len(entity) + 1), lambda k: greatest(r[k + 1], r[k] + case when entity[k] = entry[i + 1] then 1 else 0 end)) q
        from lcs where i < len(entry))),
    hit as (select entity, entry, 200.0 * r[len(r)] / (len(entity) + len(entry)) score from lcs where i = len(entry)),
    matched as (select * from eq union all select entity, first(entry order by score desc, entry), max(score)::double from hit where score >= {threshold} group by 1)"""


@query("fuzzy_match", f"""with {fuzzy_sql(f"asked as (select distinct conv_id qid, unnest({words_sql('text')}) entity from conversations)")}
  select qid, entity, coalesce(match, entity) as match, score from asked left join matched using (entity)""")
def _(s, d):
    w = S.words(F.col("text"))
    cand = K.table(s, d, "conversations").select(F.col("conv_id").alias("qid"), F.explode(F.array_distinct(w)).alias("entity")).distinct()
    return M.fuzzy_match(cand, vocab(s, d))


@query("extract_entities_with_vocabulary", f"""with {fuzzy_sql(f"b as (select doc_id qid, text, {_P} pt from documents), e as ({_SCORED}), asked as (select qid, entity, max(score)::double score from e group by 1, 2)")}
  select qid, entity, max(s)::double score from (select qid, coalesce(m.match, a.entity) entity, least(1.0, round(a.score + case when c.token is null then 0 else 0.05 end, 6)) s from asked a left join matched m using (entity)
    left join (select token from vocab where not starts_with(token, '[') and not starts_with(token, '<') and not regexp_matches(token, '^[a-z_]+\\.[a-z_]+\\.')) c on c.token = coalesce(m.match, a.entity)) x group by 1, 2""")
def _(s, d):
    return E.extract_entities(docs(s, d), vocab(s, d))


# --- sample filters ---

@query("drop_machine_ids", with_tables("paths", body="select distinct e entity from (select unnest(list_transform(entities, lambda e: case when starts_with(e, 'P') then 'm.' || e else e end)) e from paths) x where not starts_with(e, 'm.') and not starts_with(e, 'g.')"))
def _(s, d):
    e = F.col("e")
    rows = K.paths(s, d).select(F.explode("entities").alias("e")).select(F.when(e.startswith("P"), F.concat(F.lit("m."), e)).otherwise(e).alias("entity"))
    return B.drop_machine_ids(rows).distinct()


@query("drop_noise_entities", with_tables("paths", e="select distinct qid, case when qid % 3 = 0 or starts_with(x, 'P') then 'm.' || x else x end entity from (select qid, unnest(entities) x from paths) a",
       body="select qid, entity from (select *, max(case when starts_with(entity, 'm.') and len(entity) < 15 then 0 else 1 end) over (partition by qid) any_good from e) b where any_good = 0 or not (starts_with(entity, 'm.') and len(entity) < 15)"))
def _(s, d):
    x = F.col("x")
    rows = K.paths(s, d).select("qid", F.explode("entities").alias("x")).select("qid", F.when((F.col("qid") % 3 == 0) | x.startswith("P"), F.concat(F.lit("m."), x)).otherwise(x).alias("entity")).distinct()
    return B.drop_noise_entities(rows)


@query("max_path_length", with_tables("paths", body="select qid, path_no, relation_chain from paths where len(relations) between 1 and 2"))
def _(s, d):
    return B.max_path_length(K.paths(s, d), 2).select("qid", F.col("path_no").cast("bigint").alias("path_no"), "relation_chain")


@query("drop_without_paths", with_tables("paths", body="select distinct qid id from paths"))
def _(s, d):
    return B.drop_without_paths(K.samples(s, d)).select("id")


@query("require_question_and_gold", with_tables("paths", body="select distinct qid id from paths"))
def _(s, d):
    return B.require_question_and_gold(K.samples(s, d)).select("id")


@query("clean_triples", with_tables("subgraphs", body="select gid, triple_idx, subj, rel, obj from subgraphs where triple_idx % 3 <> 1"))
def _(s, d):
    g = F.transform("graph", lambda t, i: F.when(i % 3 == 1, F.array(t["subj"], t["rel"])).otherwise(F.array(t["subj"], t["rel"], t["obj"])))
    return B.clean_triples(K.samples(s, d).select("id", g.alias("graph")))


@query("sample_summary", with_tables("samples", body="select id, cast(len(graph) as integer) graph_size, cast(len(paths) as integer) path_count from samples"))
def _(s, d):
    return B.sample_summary(K.samples(s, d)).select("id", "graph_size", "path_count")


@query("is_compensated", with_tables("samples", body="select id from samples where len(paths) > 0 and id % 4 = 0"))
def _(s, d):
    bare = F.transform("paths", lambda p: p.withField("entities", F.array().cast("array<string>")))
    return B.is_compensated(K.samples(s, d).withColumn("paths", F.when(F.col("id") % 4 == 0, bare).otherwise(F.col("paths")))).select("id")


@query("limit_questions", "select o_orderkey qid from orders order by 1 limit 25")
def _(s, d):
    return B.limit_questions(K.questions(s, d).select("qid"), 25)


@query("sample_questions", "select o_orderkey qid from orders order by md5('42|' || o_orderkey), 1 limit 100")
def _(s, d):
    return B.sample_questions(K.questions(s, d).select("qid"), 100)


@query("cap_list", with_tables("paths", body="select qid, path_no from paths where path_no < 3"))
def _(s, d):
    return B.cap_list(K.paths(s, d).select("qid", F.col("path_no").cast("bigint").alias("path_no")), 3, order="path_no")
