"""Containment through the gram index, and fuzzy matching, against brute force."""

import random

from pyspark.sql import functions as F

from kgspark.operators import entity_match as M
from kgspark.operators import grams
from kgspark.operators.grams import held_names
from kgspark.functions.similarity import ascii_norm, common_subsequence


def test_containment_equals_all_pairs(spark):
    rng = random.Random(1)
    text = lambda low, high: "".join(rng.choice("abcé😀 ") for _ in range(rng.randint(low, high)))
    outer = [(rng.randint(0, 2), text(0, 30), i) for i in range(120)] + [(1, None, 900), (None, "abc", 901), (1, "abc abc", 902), (1, "abc abc", 903)]
    inner = [(rng.randint(0, 2), text(0, 4), i) for i in range(80)] + [(1, "", 800), (1, None, 801), (None, "a", 802), (1, "abc", 803), (1, "abc", 804), (2, "zzzz", 805)]
    inner += [(g, t[3:9], 1000 + i) for g, t, i in outer[:40]]
    got = grams.containment_pairs(spark.createDataFrame(outer, "gid int, hay string, o int"), spark.createDataFrame(inner, "gid int, needle string, i int"), ["gid"], "hay", "needle")
    want = sorted((i, o) for g, n, i in inner for k, h, o in outer if g is not None and g == k and n is not None and h is not None and n in h)
    assert sorted((r["i"], r["o"]) for r in got.collect()) == want and len(want) > 100
    assert set(got.columns) == {"gid", "hay", "o", "needle", "i"}


def test_gram_index_is_linear_in_the_text(spark):
    """A text of n characters gives at most n rows, however long it is; common grams do not multiply candidates."""
    long = "".join(random.Random(2).choice("abcdefgh") for _ in range(5000))
    texts = spark.createDataFrame([(1, long)], "gid int, _text string").withColumn("_hash", F.xxhash64("_text"))
    assert grams._index(texts, ["gid"], 3).count() <= len(long)
    rows = [(1, f"common name {i:04d}") for i in range(1000)]
    names = spark.createDataFrame([(1, "name 0077")], "gid int, _name string")
    many = spark.createDataFrame(rows, "gid int, _text string").withColumn("_hash", F.xxhash64("_text"))
    assert grams._candidates(many, names, ["gid"], 3).count() <= 20  # of 1 000 texts with "name"


def slow_fold(text):
    import re
    import unicodedata

    flat = unicodedata.normalize("NFKD", text.lower().strip()).encode("ascii", "ignore").decode()
    return " ".join(re.sub(r"[^\w\s]", "", flat).split())


def test_folding_equals_decomposition(spark):
    texts = ["Étienne  D'Arc", "Straße, ﬁn ½ ㎏ ℌ", "  São Tomé x\t", "ＦＵＬＬ width", "𝔄bc 𝟙", "Ω мир 日本", "", "İstanbul", "a_b-c\x1fd", "ǅ ĳ ŉ"]
    texts += ["x" + chr(c) + "y" for c in range(0x80, 0x20000, 37) if not 0xD800 <= c < 0xE000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", ascii_norm(F.col("t")).alias("o")).collect()
    wrong = [(texts[r["i"]], r["o"]) for r in got if r["o"] != slow_fold(texts[r["i"]])]
    assert not wrong
    assert spark.createDataFrame([(None,)], "t string").select(ascii_norm(F.col("t")).alias("o")).first()["o"] is None


def slow_common(a, b):
    row = [0] * (len(a) + 1)
    for y in b:
        row = [0] + [max(row[i + 1], row[i] + (x == y)) for i, x in enumerate(a)]
        for i in range(len(a)):
            row[i + 1] = max(row[i + 1], row[i])
    return row[-1]


def test_common_subsequence_of_any_length(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abc😀é") for _ in range(n))
    pairs = [("", ""), ("", "a"), ("a", ""), ("abc", "abc"), ("x" * 200, "x" * 130), ("ab" * 31, "ba" * 31)] + [(text(rng.randint(0, 150)), text(rng.randint(0, 150))) for _ in range(60)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r["i"]: r["n"] for r in rows.select("i", common_subsequence(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {i: slow_common(a, b) for i, (a, b) in enumerate(pairs)}


def test_fuzzy_match_equals_all_pairs_and_a_common_word_makes_few_rows(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    vocab = [f"company {word()} {word()}" for _ in range(400)] + [word() for _ in range(60)] + ["Époque x", "[bad] company", "a.b.c company"]
    asked = [v[:i] + v[i + 1 :] for v in vocab[:60] for i in (9,)] + ["company", "company zzz yyy", "epoque X", "nothing here", "", "company " + "q" * 90] + [word() for _ in range(20)]
    got = {r["entity"]: (r["match"], r["score"]) for r in M.fuzzy_match(spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "qid int, entity string"), spark.createDataFrame([(v,) for v in vocab], "token string")).collect()}
    entries = [v for v in set(vocab) if not v.startswith("[") and v != "a.b.c company"]
    for a in asked:
        equal = [e for e in entries if slow_fold(e) == slow_fold(a)]
        if equal:
            assert got[a] == (max(equal), 100.0)
            continue
        near = [e for e in entries if {w for w in e.lower().split() if len(w) > 2} & set(slow_fold(a).split())]
        best = min(((-200.0 * slow_common(a, e) / (len(a) + len(e)), e) for e in near), default=(0, a))
        want = (best[1], -best[0]) if -best[0] >= 80 else (a, None)
        assert got[a][0] == want[0] and (got[a][1] is None) == (want[1] is None), a


def test_dictionary_table_equals_a_search_per_entry(spark):
    rng = random.Random(4)
    words = ["ab", "a", "New York", "york", "é", "", "x y", "Ab", "zebra", "%", "w w"] + ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    texts = [None, "", "A", "new york is aB", "ÉÉ x  y", "w w w"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    texts += [texts[3]] * 2
    entries = [(w.lower(), f"e{i % 50}") for i, w in enumerate(words)] + [(None, "n"), ("ab", None)] + [("w w", "e1")] * 3
    got = sorted((r["qid"], r["entity"]) for r in M.dictionary_table_match(
        spark.createDataFrame(list(enumerate(texts)), "qid long, question string"), spark.createDataFrame(entries, "key string, entity string")).collect())
    want = sorted({(i, e) for i, t in enumerate(texts) if t is not None for k, e in entries if k is not None and e is not None and k in t.lower()})
    assert got == want
    none = spark.createDataFrame([], "key string, entity string")
    assert M.dictionary_table_match(spark.createDataFrame([(1, "a")], "qid long, question string"), none).count() == 0


def test_dictionary_names_are_found_where_the_texts_lie(spark):
    """Long texts, names over the border of two pieces, names of one and two letters, no name, other scripts; the texts do not travel."""
    rng = random.Random(5)
    words = ["the", "Le", "na", "x", "straße", "山田", "of the"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((0, 1, 3, 40, 400, 400))] + [(9, None), (10, "a" * 255 + "na the" + "b" * 300)]
    keys = ["", "x", "na", "the le", "a the", "traße 山", "na the" + "b" * 299, "the of the of the of the", "zzz", "e x", "q"]
    q = spark.createDataFrame(texts, "qid long, question string")
    names = spark.createDataFrame([(k, f"<{k}>") for k in keys] + [("x", "<other>"), (None, "n"), ("y", None)], "key string, entity string")
    entity = [(k, f"<{k}>") for k in keys] + [("x", "<other>")]
    rows = M.dictionary_table_match(q, names)
    assert sorted(map(tuple, rows.collect())) == sorted((i, e) for i, text in texts if text is not None for k, e in entity if k in text.lower())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = M.dictionary_table_match(q, names)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "hashpartitioning(low" not in plan
    assert held_names(q.select(F.col("qid").alias("id"), F.col("question").alias("text")), names.select(F.col("key").alias("name")).dropna().distinct(), most=10) is None
