"""Secret scan: candidates by pattern, false positives removed by a random forest trained from labelled findings.

Everything is DataFrame and Spark ML work on the JVM. A candidate is a run of at least ``SHORTEST`` characters that keys are made of, a
value of any length that is assigned to a key word (quoted, or up to the next blank), or a key of an issuer's format. Its features: length, shares of character classes, character transitions (shares of pairs of classes, and
how often the class changes), dictionary coverage (share of the letters that stand in runs which are words of the corpus), the
words of the path, and the neighbouring words (both hashed). The forest is fitted on at most about ``TRAIN_ROWS`` labelled findings,
chosen by hash; everything else covers whole texts and all rows.

The tables hold no labelled findings, so the query labels those of three quarters of the documents by rule (``labelled_by_rule``):
keys with an issuer's prefix and values assigned to a key word are secrets (not bare words without quotes, which may be prose); addresses, plain numbers, and plain words are not;
anything else has no label. The forest then scores all findings, by features that are not the rule.

Defined results: a null or empty text has no findings; a value that is found in a text several times is one finding, with its first
place and the number of times, judged by the words where it is assigned to a key word, if it is; a null path has no words; a null id belongs to the labelled part; repeated rows give repeated
findings; without labels of both kinds the score is the share of secrets among the labels (0 without any); an empty table gives an
empty result; other columns may have any name.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .core import query, table, text_of

SHORTEST = 16
KEY = r"A-Za-z0-9+/_=.@:\-"
CANDIDATE = rf"(?<![{KEY}])[{KEY}]{{{SHORTEST},}}+"
NEAR = 48  # characters on either side in which neighbouring words are looked for
TRAIN_ROWS = 20_000
TREES, DEPTH, HASHED = 40, 8, 256
CLASSES = {"l": "abcdefghijklmnopqrstuvwxyz", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "d": "0123456789"}  # all others: s
# fixed values: key words and issuers' formats
KEY_WORDS = ("token", "password", "passwd", "pwd", "secret", "apikey", "api_key", "api-key", "access_key", "private_key", "auth", "credential")
ISSUED = (r"AKIA[0-9A-Z]{16}", r"ASIA[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{36,}", r"sk_(live|test)_[0-9A-Za-z]{16,}", r"xox[abprs]-[0-9A-Za-z-]{10,}", r"AIza[0-9A-Za-z_-]{35}", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")


# key word, sign of assignment, value; looked for at every place, so that a key word may be the value of another
VALUE = r"""(?:"[^\n]*?(?<!\\)"|'[^\n]*?(?<!\\)'|["']?[^\s"']\S*)"""
ASSIGNED = rf"(?i)(?=((?:{'|'.join(KEY_WORDS)})\W{{0,3}}[=:]>?\s*{VALUE}))"
# of an assignment: all before the value, and the value; with quotes about it, and without
QUOTED = r"""(?s)^(\w[\w-]*\W{0,3}?[=:]+>?\s*(["']))(.*)\2$"""
BARE = r"""(?s)^(\w[\w-]*\W{0,3}?[=:]+>?\s*["']?)(.*?)["'`,;)\]}>]*$"""
ANY_ISSUED = "(?:" + "|".join(ISSUED).replace("(live|test)", "(?:live|test)") + ")"


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``doc_id, path, candidate, at (from 1), times, before, after``: every distinct candidate of every text."""
    text = text_of(text_col)

    def parts(kind: int, pattern: str, group: int, split) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda c: F.struct(c.alias("whole"), *[x.alias(n) for n, x in zip(("name", "value"), split(c))], F.lit(kind).alias("kind")))

    def assigned(c: Column) -> list[Column]:
        return [F.when(c.rlike(QUOTED), F.regexp_extract(c, QUOTED, q)).otherwise(F.regexp_extract(c, BARE, b)) for q, b in ((1, 1), (3, 2))]

    def run(c: Column) -> list[Column]:
        # a value assigned without blanks ("password=...") keeps its name as the word before it
        return [F.regexp_extract(c, r"^([A-Za-z_\-]+[=:])?(.*)$", k) for k in (1, 2)]

    every = F.concat(parts(0, ASSIGNED, 1, assigned), parts(1, ANY_ISSUED, 0, lambda c: [F.lit(""), c]), parts(2, CANDIDATE, 0, run))
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(path_col).cast("string").alias("path"), text.alias("text"), F.filter(every, lambda c: c["value"] != "").alias("all")).filter(F.size("all") > 0)
    each = found.select("doc_id", "path", "text", "all", F.explode(F.array_distinct(F.col("all.value"))).alias("value"))
    each = each.withColumn("mine", F.filter("all", lambda c: c["value"] == F.col("value"))).drop("all")
    # the same place may be found in several ways
    times = F.array_max(F.transform(F.array(*map(F.lit, range(3))), lambda k: F.size(F.filter("mine", lambda c: c["kind"] == k))))
    places = F.transform(F.array_distinct("mine"), lambda c: F.instr(F.col("text"), c["whole"]) + F.length(c["name"]))
    each = each.withColumns({"times": times, "first": F.array_min(places), "whole": F.col("mine")[0]["whole"], "name": F.col("mine")[0]["name"]}).withColumn("at", F.instr(F.col("text"), F.col("whole")))
    start = F.greatest(F.lit(1), F.col("at") - NEAR)
    return each.select("doc_id", "path", F.col("value").alias("candidate"), F.col("first").alias("at"), "times", F.concat(F.col("text").substr(start, F.col("at") - start), "name").alias("before"),
                       F.col("text").substr(F.col("at") + F.length("whole"), F.lit(NEAR)).alias("after"))


def labelled_by_rule(found: DataFrame) -> DataFrame:
    """``label``: 1.0 or 0.0, null where the rule says nothing."""
    c = F.col("candidate")
    assigned = F.lower("before").rlike(rf"({'|'.join(KEY_WORDS)})\W{{0,3}}[=:]>?\s*[\"']?$")
    bare = c.rlike(r"^[\p{L}.]+$") & (F.length(c) < SHORTEST) & ~F.col("before").rlike("[\"']$")
    plain = c.rlike(r"@") | c.rlike(r"^[0-9.:/\-]+$") | c.rlike(r"^[a-z]+[.:/][a-z0-9.:/=_\-]+$") | c.rlike(r"^[A-Za-z.\-]+[0-9]{0,4}[.:]?$")
    issued = c.rlike("^(" + "|".join(ISSUED) + ")$")
    return found.withColumn("label", F.when(issued, 1.0).when(assigned, F.when(~bare, 1.0)).when(plain, 0.0))


def with_features(found: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``numbers (array<double>)`` and ``words (array<string>)``. The dictionary is the words of the whole corpus."""
    c = F.col("candidate")
    kinds = F.translate(c, "".join(CLASSES.values()), "".join(k * len(v) for k, v in CLASSES.items()))
    kinds = F.regexp_replace(kinds, "[^lud]", "s")
    n = F.length(c).cast("double")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 1)), lambda i: F.substring(F.col("kinds"), i, F.lit(2)))
    runs = F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 3)
    found = cut_lineage(found.withColumn("kinds", kinds).withColumns({"pairs": pairs, "runs": runs, "row": F.monotonically_increasing_id()}))
    dictionary = docs.select(F.explode(F.split(F.lower(text_of(text_col)), r"[\x20\x09-\x0D]+")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("often"))
    wanted = found.select("row", F.explode("runs").alias("w"))
    known = wanted.join(wanted.select("w").distinct().join(dictionary, "w").filter("often > 1").select("w"), "w")
    covered = known.groupBy("row").agg(F.sum(F.length("w")).alias("covered"))
    out = found.join(covered, "row", "left").withColumn("covered", F.coalesce("covered", F.lit(0)) / n)

    def part(pair: str) -> Column:
        return F.size(F.filter("pairs", lambda p: p == pair)) / n

    share = [part(a + b) for a in "luds" for b in "luds"]
    changes = F.size(F.filter("pairs", lambda p: p.substr(1, 1) != p.substr(2, 1))) / n
    classes = [(F.length("kinds") - F.length(F.replace(F.col("kinds"), F.lit(k)))) / n for k in "luds"]
    distinct = F.size(F.array_distinct(F.split(c, ""))) / n
    numbers = F.array(*[x.cast("double") for x in (n, *classes, *share, changes, distinct, F.col("covered"))])

    def words(text: Column, where: str, last: bool) -> Column:
        near = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}_]+"), F.lit(0))
        near = F.slice(near, F.greatest(F.lit(1), F.size(near) - 1), F.lit(2)) if last else F.slice(near, 1, 2)
        return F.transform(near, lambda w: F.concat(F.lit(where), w))

    path = F.transform(F.filter(F.split(F.lower(F.coalesce("path", F.lit(""))), "[^a-z]+"), lambda w: w != ""), lambda w: F.concat(F.lit("path:"), w))
    return out.withColumn("numbers", numbers).withColumn("words", F.concat(words(F.col("before"), "before:", True), words(F.col("after"), "after:", False), path)).drop(
        "kinds", "pairs", "runs", "row", "covered")


def scored(featured: DataFrame, train_rows: int = TRAIN_ROWS, seed: int = 42) -> DataFrame:
    """Adds ``score``, the forest's probability that a finding is a secret. Rows with a ``label`` train it."""
    featured = cut_lineage(featured)
    have = {r["label"]: r["n"] for r in featured.filter("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(have.values())
    if len(have) < 2:
        return featured.withColumn("score", F.lit(have.get(1.0, 0) / total if total else 0.0))
    chance = F.pmod(F.xxhash64("candidate", "before"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    width = len(featured.select("numbers").first()["numbers"])
    flat = featured.withColumns({f"f{i}": F.col("numbers")[i] for i in range(width)})
    stages = [HashingTF(inputCol="words", outputCol="hashed", numFeatures=HASHED, binary=True), VectorAssembler(inputCols=[f"f{i}" for i in range(width)] + ["hashed"], outputCol="features")]
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=seed, probabilityCol="p", rawPredictionCol="raw", predictionCol="guess")
    # half of the rows for each kind where there are so many; weights restore their shares
    kinds = F.create_map(*[F.lit(float(x)) for k, n in have.items() for x in (k, max(1.0, 2 * n / train_rows))])
    train = flat.filter("label is not null").withColumn("weight", kinds[F.col("label")]).filter(chance * F.col("weight") < 1)
    model = Pipeline(stages=[*stages, forest]).fit(train)
    return model.transform(flat).withColumn("score", vector_to_array("p")[1]).drop("hashed", "features", "raw", "p", "guess", *[f"f{i}" for i in range(width)])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``doc_id, candidate, at, times, score, secret``; labels come by rule, from the documents that are not held out."""
    found = labelled_by_rule(findings(docs, id_col, text_col, path_col))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = found.withColumn("label", F.when(~held, F.col("label")))
    return scored(with_features(found, docs, text_col)).select("doc_id", "candidate", "at", "times", "score", (F.col("score") >= 0.5).alias("secret"))


@query("op1_secrets")
def op1(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
