"""Queries whose rows lie by question do not send them through a shuffle again, and give what they gave before."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from kgspark.operators import entity_match as M
from kgspark.operators import indexes as I
from kgspark.operators import path_search as P
from kgspark.operators import retrieval as J
from kgspark.operators.adjacency import Adjacency, outgoing
from kgspark.plans import canonical as K

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    df = df.toDF(*df.columns)
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled(df, *columns: str) -> bool:
    """Whether rows are dealt anew by one of these columns, or by it and others before the question."""
    return any(re.search(rf"hashpartitioning\({c}#\d+L?, \d+\)|hashpartitioning\({c}#.*qid#", plan(df)) for c in columns)


@pytest.fixture
def low_limit(spark):
    """What is sent to all tasks has to be as small here as it would be beside large tables."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "256k")
    yield
    spark.conf.set(name, before)


def test_found_entities_are_counted_where_they_lie(spark):  # F9 extraction_coverage, F43 candidate_recall
    from kgspark.operators import metrics
    from kgspark.registry.lists import candidates

    found = candidates(spark, SF)
    assert "Exchange" not in plan(found) and "Broadcast" not in plan(found)
    per_path = found.withColumn("rank", F.lit(1))
    assert not shuffled(metrics.extraction_coverage(per_path, per_path, K.a_entities(spark, SF)), "gid", "low")


def test_names_are_matched_in_their_graph_without_grams(spark):  # F16 label_reasoning_paths
    graphs = K.subgraphs(spark, SF)
    ways = Adjacency(outgoing(graphs), by_graph=True)
    names = ways.place(K.topics(spark, SF).join(graphs.select("gid").distinct(), "gid", "left_semi"))
    got = M.match_entities(names, graphs, ways)
    assert "Generate" not in plan(got) and "Exchange" not in plan(got)
    rows = lambda df: sorted(map(tuple, df.select("qid", "match").collect()))
    assert rows(got) == rows(names.withColumn("match", F.col("entity")))
    loose = spark.createDataFrame([(1, 1, "ing"), (2, 1, "Sing")], "qid long, gid long, entity string")
    one = spark.createDataFrame([(1, 0, "sing", "r", "b")], "gid long, triple_idx long, subj string, rel string, obj string")
    assert rows(M.match_entities(loose, one)) == [(1, "sing"), (2, "sing")]


def test_loose_paths_are_followed_in_their_graph(spark):  # F17 direct_selection
    ranked = K.ranked(spark, SF)
    there = J.path_entities(K.topics(spark, SF), ranked, K.subgraphs(spark, SF), 3, by_graph=True)
    assert not shuffled(there, "gid", "path_rel", "graph_rel", "entity")
    away = J.path_entities(K.q_entities(spark, SF).withColumn("gid", F.col("qid")), ranked, K.subgraphs(spark, SF), 3)
    assert there.count() == away.count() and there.exceptAll(away).isEmpty()


def test_samples_and_path_texts_are_not_written(spark):  # F18 parse_nested and the queries that read samples or paths
    from kgspark.session import cut_lineage

    assert "kgspark_" in plan(K.samples(spark, SF)) and "posexplode" not in plan(K.paths(spark, SF))
    assert set(K.path_steps(spark, SF).columns) == {"qid", "path_no", "entities", "relations"}
    assert "array_sort" in plan(K.samples(spark, SF))  # made where it is read
    assert cut_lineage(K.paths(spark, SF)).filter("full_path is null or relation_chain is null").isEmpty()


@pytest.mark.parametrize("by", ["qid", None])
def test_a_token_is_asked_once_per_question(spark, by):  # F22 encode_paths, F26 decode_tokens
    rows = spark.createDataFrame([(q, i, t) for q in range(3) for i, t in enumerate(["a", "b", "a", None, "x", "a"])], "qid long, i int, token string")
    vocab = spark.createDataFrame([("a", 5), ("b", 6)], "token string, idx long")
    got = I.encode_tokens(rows, vocab, "token", by=by)
    assert sorted((r.qid, r.i, r.idx) for r in got.collect()) == [(q, i, x) for q in range(3) for i, x in enumerate([5, 6, 5, 1, 1, 5])]
    assert (plan(got).count("HashAggregate") > 0) == (by is not None)


def test_sequences_of_no_question_are_decoded_too(spark):  # F26 decode_tokens
    vocab = spark.createDataFrame([("a", 5), ("b", 6)], "token string, idx long")
    rows = spark.createDataFrame([(1, [5, 6, 5, 0, 6, 6]), (None, [6, 0, 5, 1, 6])], "qid long, indices array<long>")
    got = sorted(map(repr, map(tuple, I.decode_tokens(rows, vocab).collect())))
    assert got == sorted(map(repr, [(1, 0, "a -> b -> a"), (1, 1, "b -> b"), (None, 0, "b"), (None, 1, "a")]))


@pytest.mark.parametrize("name", ["reader_rows", "search_patterns", "question_pattern_pairs"])  # F24, F27, F29
def test_patterns_are_sent_to_the_lists_of_the_questions(spark, name, low_limit):
    assert not shuffled(entry_point.queries()[name](spark, SF), "subgraph_id", "relation")


def test_steps_of_paths_meet_their_triples_in_place(spark):  # F30 path_triples, F36 subgraph_patterns
    paths = K.paths(spark, SF).withColumn("gid", F.col("qid"))
    assert "Exchange" not in plan(P.path_triples(paths, K.subgraphs(spark, SF)))


def test_boosts_leave_the_lists_where_they_are(spark, low_limit):  # F41 ensemble_rank
    assert not shuffled(entry_point.queries()["ensemble_rank"](spark, SF), "path_id")


def test_texts_are_not_dealt_by_phrase_beside_a_small_vocabulary(spark, low_limit):  # F32 extract_entities_fast_vocabulary, F39 phrase_lookup
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4m")  # the vocabulary of the benchmark, which is as large in every folder
    for name in ("phrase_lookup", "extract_entities_fast_vocabulary"):
        assert not shuffled(entry_point.queries()[name](spark, SF), "low")


def test_postings_stay_with_their_path(spark, low_limit):  # F38 bm25_search_shuffled
    corpus = spark.createDataFrame([(i, f"w{i % 3} common x{i}") for i in range(50)], "path_id long, path string")
    index = J.bm25_index(corpus, "split", rows_per_part=10)
    assert "Exchange hashpartitioning" not in plan(index.postings)
    asked = spark.createDataFrame([(1, "common w1 w1")], "qid long, question string")
    assert not shuffled(J.bm25_search(asked, index, None, "split"), "term", "path_id")


def test_targets_and_answers_meet_in_their_question(spark, monkeypatch):  # F1 shortest_covering_paths
    from kgspark.operators import grams, ranking

    df = entry_point.queries()["shortest_covering_paths"](spark, SF)
    assert "substring(target" not in plan(df) and "sequence(" not in plan(df)  # no grams beside small questions
    assert not shuffled(df, "target", "_hash")
    paths = [(q, i, ["O", t], ["r"] * h, f"t{i}", "r") for q in (1, 2, None) for i, (t, h) in enumerate([("Abc", 2), ("abc ", 1), ("xy", 1), ("b", 1), ("", 1)])]
    p = spark.createDataFrame(paths, "qid long, path_no long, entities array<string>, relations array<string>, full_path string, relation_chain string")
    a = spark.createDataFrame([(1, "ABC"), (1, "xyz"), (1, "none"), (2, "bc"), (2, ""), (2, None), (None, "abc")], "qid long, entity string")
    rows = lambda: sorted(map(tuple, ranking.shortest_covering_paths(p, a).select("qid", "via", "full_path").collect()))
    few = rows()
    assert few == [(1, "ABC", "t1"), (1, "xyz", "t2"), (2, "", "t1")]
    whole = grams.crowded
    monkeypatch.setattr(grams, "crowded", lambda *of: whole(*of, most=1))
    assert rows() == few  # crowded questions, through the grams


def test_gold_is_sought_in_all_paths_of_its_question(spark, monkeypatch):  # F6 context_recall
    from kgspark.operators import answers, grams

    df = entry_point.queries()["context_recall"](spark, SF)
    assert "order.order.customer" not in plan(df) and "order.order.customer" not in entry_point.oracle_sql()["context_recall"].split("context_recall from")[1]
    assert "sequence(" not in plan(df)  # no grams beside small questions
    assert df.first()[0] == 1.0  # every supplying region ends one of the order's paths
    texts = spark.createDataFrame([(1, "O1 --r--> Old_Rome"), (1, "O1 --r--> Ulm"), (2, "O2 --r--> Ulm"), (3, None), (None, "Ulm")], "qid long, text string")
    gold = spark.createDataFrame([(1, "the"), (1, "old rome!"), (1, "OldRome"), (2, "Rome"), (3, "Ulm"), (4, ""), (5, None), (None, "Ulm"), (2, None)], "qid long, entity string")
    assert answers.context_recall(texts, gold).first()[0] == round(1 / 6, 6)
    whole = grams.crowded
    monkeypatch.setattr(grams, "crowded", lambda *of: whole(*of, most=1))
    assert answers.context_recall(texts, gold).first()[0] == round(1 / 6, 6)


def test_rows_come_back_from_a_node_once(spark, monkeypatch):  # F5 follow_path
    from kgspark.operators import traversal as T

    df = entry_point.queries()["follow_path"](spark, SF)
    back = re.search(r"Exchange hashpartitioning\(qid#.*REPARTITION_BY_NUM.*", plan(df), re.S)[0]
    assert "ways" in back and "Union" in back and "over#" not in back  # one row for a node, with all ways on, none for each path
    triples = [(0, "a", "r", f"b{i}", i) for i in range(3)] + [(0, f"b{i % 2}", x, f"c{i % 3}", i) for i in range(6) for x in "st"] + [(0, f"c{i}", "u", "d", i) for i in range(3)]
    g = spark.createDataFrame(triples, "gid long, subj string, rel string, obj string, triple_idx long")
    starts = spark.createDataFrame([(1, 0, "a"), (2, 0, "A"), (3, 0, "none"), (None, 0, "a")], "qid long, gid long, entity string")
    chains = [["r"], ["r", "s"], ["r", "t"], ["r", "s", "u"], ["s"], ["r", None]]
    paths = spark.createDataFrame([(q, i, c) for q in (1, 2, 3, None) for i, c in enumerate(chains)][1:], "qid long, path_id long, relations array<string>")
    rows = lambda: sorted(map(tuple, T.follow_path(starts, paths, g).collect()))
    texts = lambda: sorted(map(tuple, T.instantiate_paths(starts, paths.select("qid", F.array_join("relations", " -> ").alias("path")).filter("path <> ''"), g).collect()))
    got, told = rows(), texts()
    ends = {0: ["b0", "b1", "b2"], 1: ["c0", "c1", "c2"], 2: ["c0", "c1", "c2"], 3: ["d"]}
    assert got == sorted((q, 0, s, i, e) for q, s in ((1, "a"), (2, "A")) for i, es in ends.items() for e in es if (q, i) != (1, 0))
    assert (1, "a --r--> b0 --s--> c2 --u--> d") in told and len(told) == len(set(told))
    monkeypatch.setattr(T, "PLAN_PATHS", 0)
    monkeypatch.setattr(T, "LIST_ROWS", 1)
    assert rows() == got and texts() == told


@pytest.mark.parametrize("most", [1, 1000])
def test_frequent_tokens_do_not_travel(spark, monkeypatch, most):  # F2 decode_tokens
    rows = spark.createDataFrame([(q, i, t) for q in range(40) for i, t in enumerate(["nation", f"o{q}", "none", None, f"p{q}"])], "qid long, i int, token string")
    vocab = spark.createDataFrame([("nation", 5), ("o1", 6), ("o2", 7), ("never", 8)], "token string, idx long")
    monkeypatch.setattr(I, "OFTEN", most)
    got = I.encode_tokens(rows, vocab, "token", by="qid")
    assert sorted((r.qid, r.i, r.idx) for r in got.collect()) == sorted(
        (q, i, x) for q in range(40) for i, x in enumerate([5, {1: 6, 2: 7}.get(q, 1), 1, 1, 1]))
    assert sorted(got.columns) == ["i", "idx", "qid", "token"]
    assert "_often" in plan(got) and not re.search(r"SortMergeJoin \[token#\d+\], \[token#\d+\], LeftOuter", plan(got))  # only known tokens come back
    read = I.decode_tokens(spark.createDataFrame([(1, [5, 6, 99, 0, 99, 2, 7])], "qid long, indices array<long>"), vocab)
    assert sorted(map(tuple, read.collect())) == [(1, 0, "nation -> o1"), (1, 2, "o2")]


def test_parts_grow_out_of_sorted_rows(spark, tmp_path):  # F4 write_parts
    import glob

    import pyarrow.parquet as pq

    from kgspark.sources import writers

    at = str(tmp_path / "parts")
    writers.write_parts(K.order_rows(spark, SF).drop("asked"), at, ["gid"], 700, grow=K.paths_of)
    files = [pq.read_table(f) for f in sorted(glob.glob(f"{at}/*.parquet"))]
    assert len(files) > 1 and max(f.num_rows for f in files) <= 700
    keys = [k for f in files for k in zip(f["qid"].to_pylist(), f["path_no"].to_pylist())]
    assert keys == sorted(keys)
    there, paths = spark.read.parquet(at), K.paths(spark, SF)
    assert there.dtypes == paths.dtypes and there.count() == paths.count() and there.exceptAll(paths).isEmpty()
    writers.write_parts(paths, str(tmp_path / "plain"), ["qid", "path_no"], 700)
    assert spark.read.parquet(str(tmp_path / "plain")).exceptAll(there).isEmpty()


def test_only_matching_paths_and_their_relations_are_followed(spark):  # F3 direct_selection
    ranked, gold, graphs = K.ranked(spark, SF), K.gold(spark, SF), K.subgraphs(spark, SF)
    some = J.gold_matches(ranked, gold, 5)
    assert 0 < some.count() < ranked.count() / 4
    few = J.path_entities(K.topics(spark, SF), some, graphs, 3, 5, by_graph=True)
    everything = J.path_entities(K.topics(spark, SF), ranked, graphs, 3, by_graph=True)
    rows = lambda e: sorted(map(repr, map(tuple, J.direct_selection(ranked, gold, e, 5, 5).collect())))
    assert rows(few) == rows(everything)
    assert plan(few).count("LeftSemi") >= 3  # a hop takes the edges that some path takes there
    assert "md5" not in plan(entry_point.queries()["direct_selection"](spark, SF))  # the lists are put in order once
