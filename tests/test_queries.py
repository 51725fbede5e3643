"""A cross-section of the registered queries against their SQL twins on the smallest data."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["answer_by_traversal", "follow_path", "retrieve_with_fallbacks", "enumerate_simple_paths", "bfs_paths_undirected", "shortest_covering_paths", "rrf_fuse",
        "retrieval_report", "answer_report", "unified_vocabulary_entities", "bm25_search", "contrastive_examples", "encode_paths", "classify_question",
        "extract_entities", "parse_nested", "train_val_split"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data not present")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([repr([float(plain(r[i])) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else plain(r[i]) for i in order]) for r in rows])


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, sql, name):
    df = entry_point.queries()[name](spark, DATA)
    r = sql.execute(entry_point.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(cols)
    assert table(df.columns, [tuple(x) for x in df.collect()]) == table(cols, r.fetchall())


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_twin_belongs_to_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_lists_have_no_default_caps(spark):
    from kgspark.operators import retrieval

    n = 40
    topics = spark.createDataFrame([(1, 1, "hub")], "qid long, gid long, entity string")
    triples = spark.createDataFrame([(1, i, "hub", "a.b.c", f"leaf {i:02}") for i in range(n)], "gid long, triple_idx long, subj string, rel string, obj string")
    ranked = spark.createDataFrame([(1, 1, "a.b.c")], "qid long, rank int, path string")
    questions = spark.createDataFrame([(1, 1, "which leaf")], "qid long, gid long, question string")
    assert retrieval.candidate_entities(questions, topics, ranked, triples, 1).count() == n
    assert retrieval.path_entities(topics, ranked, triples, 1).count() == n
    written = spark.createDataFrame([(1, i + 1, f"hub -> a.b.c -> leaf {i:02}") for i in range(n)], "qid long, rank int, path string")
    few, many = retrieval.entities_from_paths(written, None, 10, 15).count(), retrieval.entities_from_paths(written).count()
    assert few < n <= many


def test_texts_and_prompts_have_no_default_caps(spark):
    from pyspark.sql import functions as F

    from kgspark.functions import questions as Q
    from kgspark.functions import scalars as S
    from kgspark.operators import training

    n = 30
    row = spark.range(1).select(F.array(*[F.lit(f"(a) --[r]--> (b{i:02})") for i in range(n)]).alias("t"), F.array(*([F.lit("a.b.c")] * 8 + [F.lit("x.location.region")])).alias("p"))
    got = row.select(S.sort_path_texts(F.col("t")).alias("all"), S.sort_path_texts(F.col("t"), 4).alias("few"), Q.answer_type_hints(F.col("p")).alias("far"), Q.answer_type_hints(F.col("p"), 5).alias("near"),
                     S.hash_bucket(F.lit(None), 7).alias("null"), S.hash_bucket(F.lit(""), 7).alias("empty")).first()
    assert (got["all"].count("\n"), got["few"].count("\n")) == (n - 1, 3)
    assert got["far"] and not got["near"]
    assert got["null"] == got["empty"]
    questions = spark.createDataFrame([(1, "which")], "qid long, question string")
    ranked = spark.createDataFrame([(1, i + 1, f"p{i}") for i in range(n)], "qid long, rank int, path string")
    entities = spark.createDataFrame([(1, i + 1, f"p{i}", 1, f"e{i}") for i in range(n)], "qid long, rank int, path string, no int, entity string")
    prompt = training.context_rows(questions, ranked, entities).first()["prompt"]
    few = training.context_rows(questions, ranked, entities, 3, candidates=2).first()["prompt"]
    assert (prompt.count("• "), prompt.split("Candidates: ")[1].split("\n")[0].count(",")) == (n, n - 1)
    assert (few.count("• "), few.split("Candidates: ")[1].split("\n")[0]) == (3, "e0, e1")


def test_sql_functions_equal_the_scalars(spark):
    from pyspark.sql import functions as F

    from kgspark.functions import scalars as S
    from kgspark.operators import hooks

    hooks.register_sql_functions(spark)
    texts = [None, "", " ", "\u00a0The\u2003Answer\u3000is\x85an, A\x1c(b)! \u00a0", "a.b.c_d", "people.person.place_of_birth", "x.y_z", "plain_text", "\u2028A -> \u00a0B\x0b->C ->", "it's \"quoted\" \\ back", "é.Ü.ß_x",
             "¿qué? — “no”", "a..b", ".", "location.location.containedby", "the"]
    rows = [(i, a, b, None if i % 7 == 0 else [a, b, a][: i % 4]) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)]
    rows += [(-1, "r", "r", ["relation.with.a_long_name"] * 5), (-2, "r", "r", ["x" * 95]), (-3, "r", "r", ["x" * 96])]
    table = spark.createDataFrame(rows, "i long, a string, b string, rs array<string>")
    pairs = {"kg_norm_path(a)": S.norm_path(F.col("a")), "kg_norm_answer(a)": S.norm_answer(F.col("a")), "kg_relation_matches(a, b)": S.relation_matches(F.col("a"), F.col("b")),
             "kg_relation_to_text(a)": S.relation_to_text(F.col("a")), "kg_subgraph_id(rs)": S.subgraph_id(F.col("rs"))}
    both = table.select("i", "a", "b", "rs", *[F.struct(F.expr(k).alias("sql"), c.alias("col")).alias(k.split("(")[0]) for k, c in pairs.items()])
    for r in both.collect():
        for k in pairs:
            k = k.split("(")[0]
            assert r[k]["sql"] == r[k]["col"], (k, r["a"], r["b"], r["rs"], r[k])
