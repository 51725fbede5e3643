"""SimHash links, whitening and conversation repair against brute force."""

import hashlib
import os
import random
import zlib
from functools import cache

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kgspark.llm import conversations, load_all, simhash, whitening

DATA = "/root/testdata/sf0.001"


def classes(nodes, linked):
    """The smallest member of each node's component."""
    found = {}
    for n in sorted(nodes):
        if n in found:
            continue
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in found:
                found[x] = n
                todo += [y for y in nodes if y not in found and linked(x, y)]
    return found


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\f\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_of_texts(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    base = [rng.choice(words) for _ in range(400)]
    texts = [None, "", " \t\n", "One", "ONE", "a b c", "A B  c\x0bd", " ".join(base * 30), "é x y z w", "x" * 70_000]
    texts += [" ".join(base[:i] + ["new"] + base[i + 1 :]) for i in range(0, 400, 20)] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    rows = [(i, t, "m", "r", "p") for i, t in enumerate(texts + texts[-4:])]
    docs = spark.createDataFrame(rows + [(None, texts[20], "m", "r", "p")], "doc_id long, text string, mark string, rep string, place string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    marks = {i: slow_fingerprint(t) for i, t, *_ in rows}
    want = classes(list(marks), lambda x, y: (marks[x] ^ marks[y]).bit_count() <= 4)
    assert got == {i: (f"{marks[i]:016x}", want[i]) for i in marks} | {None: (f"{slow_fingerprint(texts[20]):016x}", None)}
    assert len(set(want.values())) < len(set(marks.values()))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert docs.limit(3).select(F.xxhash64(F.lit("a b"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest("a b", 42)


@pytest.mark.parametrize("bits", [1, 3, 4])
def test_simhash_links_are_exact(spark, bits):
    """Chains whose steps are just in reach, balls of near misses around a centre, and marks just out of reach."""
    rng = random.Random(bits)
    marks = set()

    def flipped(m, n):
        return m ^ sum(1 << b for b in rng.sample(range(64), n))

    for _ in range(6):
        m = rng.getrandbits(64)
        marks.add(m)
        for _ in range(15):
            m = flipped(m, bits)
            marks.add(m)
    centre = rng.getrandbits(64)
    marks |= {flipped(centre, rng.randint(1, 7)) for _ in range(250)} | {flipped(centre, bits + 1), 0, (1 << 64) - 1}
    rows = [(i, m - (1 << 64) if m >> 63 else m) for i, m in enumerate(sorted(marks))]
    got = {r["mark"]: r["component"] for r in simhash.linked(spark.createDataFrame(rows, "rep long, mark long"), bits).collect()}
    plain = {i: m % (1 << 64) for i, m in rows}
    want = classes(list(plain), lambda x, y: (plain[x] ^ plain[y]).bit_count() <= bits)
    assert {i: got.get(m, i) for i, m in rows} == want


def check_whitening(rows, got, k):
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    centred = np.array([[n * r[j] - sums[j] for j in range(d)] for r in x], float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == n * min(k, d)
    table = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(min(k, d)):
        mine = np.array([table[i, c + 1]["whitened"] for i, _ in rows])
        want = centred @ vectors[:, c] / np.sqrt(values[c])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6
        assert abs(table[rows[0][0], c + 1]["explained"] / (values[c] / values.sum()) - 1) < 1e-9
    for (i, _), r in zip(rows, x):
        assert table[i, 1]["deviation"] == sum((n * v - s) ** 2 for v, s in zip(r, sums)) and table[i, 1]["n"] == n
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-6


def test_whitening(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))).astype("float32").tolist()
    rows = list(enumerate(vectors))
    bad = [(1000, None), (1001, [1.0] * 5 + [None]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1004, []), (1005, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, row_no string").repartition(3)
    check_whitening(rows, whitening.whitened(table, components=4).collect(), 4)
    monkeypatch.setattr(whitening, "WIDTH", 4)  # several blocks of columns
    monkeypatch.setattr(whitening, "CELLS", 64)  # and of rows
    check_whitening(rows, whitening.whitened(table, components=32).collect(), 32)
    twice = whitening.whitened(table.filter("vec_id < 300").union(table.filter("vec_id < 300")), components=2).collect()
    assert len(twice) == 1200 and twice[0]["n"] == 600 and twice[0]["identity_error"] < 1e-6


def test_whitening_without_variance(spark):
    flat = spark.createDataFrame([(None, [1.0, 2.0, 3.0]), (1, [1.0, 3.0, 3.0])], "vec_id long, embedding array<double>")
    got = {(r["vec_id"], r["component"]): r for r in whitening.whitened(flat).collect()}
    assert len(got) == 6 and got[1, 2]["whitened"] is None and got[1, 2]["explained"] == 0 and got[1, 1]["explained"] == 1
    assert abs(got[1, 1]["whitened"] + got[None, 1]["whitened"]) < 1e-9 and got[1, 1]["identity_error"] < 1e-9
    assert [r["whitened"] for r in whitening.whitened(flat.limit(1)).collect()] == [None] * 3
    assert whitening.whitened(flat.limit(0)).collect() == []


def slow_repair(rows):
    """All that the report says, of ``(turn, role, text)`` after damage in any order: every way to edit is tried."""
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in rows))
    seen, faults = set(), []
    for _, _, role, text in rows:
        told = text.strip(" \t\n\x0b\f\r")
        faults.append("blank" if not told else "duplicate" if (role, text) in seen else "truncated" if told[-1] not in ".!?" else "")
        seen.add((role, text))

    def follows(state, c):
        return c if (state in ("", "a") and c == "u") or (state == "s" and c == "u") or (state == "u" and c == "a") or (state == "" and c == "s") else None

    @cache
    def best(i, state, inserts):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def add(cost, edit, out, rest):
            ways.append((cost + rest[0], edit + rest[1], out + rest[2]))

        if inserts:
            for c, name in (("u", "user"), ("a", "assistant")):
                if follows(state, c):
                    add(3, "I", (f"{name}:",), best(i, c, inserts - 1))
        if i < len(rows):
            _, _, role, text = rows[i]
            add(4, "D", (), best(i + 1, state, 2))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if role[:1] in ("s", "u", "a") and follows(state, role[:1]):
                    add(more, "K", (f"{role}:{text}",), best(i + 1, role[0], 2))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if follows(state, c):
                        add(more + 3, "R", (f"{name}:{text}",), best(i + 1, c, 2))
        return min(ways, default=(1 << 40, "", ()))

    cost, audit, out = best(0, "", 2)
    turns = [t for has, t, *_ in rows if has]
    initials = [r[2][:1] for r in rows]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}, list(out)


SCHEMA = "conv_id long, turn long, role string, text string, conv string, fault string, kind string, left string"


@pytest.mark.parametrize("limit", [conversations.SPILL, 20])
def test_conversations_against_all_ways(spark, limit):
    rng = random.Random(9)
    texts = ["yes.", "no", "", " \n", "Why?  ", "a.b", None, "ok!", "é…", "two\nlines."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "", "umpire", "User"]
    made = {c: [(rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}.") for _ in range(rng.randint(1, 9))] for c in range(150)}
    made[None] = [(1, "user", "hello."), (2, "assistant", "hi.")]
    made[-1] = [(i, ("user", "assistant")[i % 2], f"text {i}.") for i in range(1200)]
    made[-1][701] = (701, "user", "odd one out")
    rows = [(c, *r, "x", "x", "x", "x") for c, rs in made.items() for r in rs]
    rng.shuffle(rows)
    ordered = conversations.sorted_rows(spark.createDataFrame(rows, SCHEMA))
    got = {r["conv"]: r.asDict() for r in conversations.reports(ordered, limit).collect()}
    turns = {}
    for r in conversations.repaired_turns(ordered, limit).collect():
        turns.setdefault(r["conv"], {})[r["place"]] = f"{r['role']}:{r['text']}"
    assert set(got) == {None if c is None else str(c) for c in made}
    for c, rs in made.items():
        key = None if c is None else str(c)
        if c == -1:
            assert got[key]["cost"] == 6 and len(got[key]["audit"]) == 1200
            continue
        want, out = slow_repair(rs)
        assert {k: v for k, v in got[key].items() if k != "conv"} == want, (c, rs)
        assert [turns.get(key, {}).get(i) for i in range(len(out))] == out and len(turns.get(key, {})) == len(out)


def test_damage_and_conversations_without_rows(spark):
    rows = [(c, t, r, x, "c", "f", "k", "l") for c in range(60) for t, r, x in ((0, "system", "be good."), (1, "user", "a. b! c?"), (2, "assistant", "fine."))]
    rows += [(None, None, None, None, "c", "f", "k", "l"), (None, 3, "user", "z.", "c", "f", "k", "l")]
    table = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for c, t, r, x, *_ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        x = {1: "", 2: x.replace(".", "").replace("!", "").replace("?", "")}.get(kind, x)
        want.setdefault(c, []).extend([(t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1))
    ordered = conversations.sorted_rows(conversations.damaged(table), left=F.col("left"))
    got = {r["conv"]: r.asDict() for r in conversations.reports(ordered).collect()}
    for c, rs in want.items():
        assert {k: v for k, v in got[None if c is None else str(c)].items() if k != "conv"} == slow_repair(rs)[0]
    alone = conversations.reports(conversations.sorted_rows(table.limit(1), left=F.lit(False))).collect()
    assert [tuple(r)[1:] for r in alone] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.reports(conversations.sorted_rows(table.limit(0))).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test data not present")
def test_conversation_query_equals_sql(spark):
    asked, twins = load_all()
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    found = con.execute(twins["op13_conversation_repair"])
    names = [c[0] for c in found.description]
    want = sorted(found.fetchall())
    got = asked["op13_conversation_repair"](spark, DATA)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == want and len(want) > 5


def test_parity_sketch_never_exceeds_the_difference():
    from kgspark.llm import near_dedup

    rng = np.random.default_rng(2)
    for n in (1, 30, 400, 5000):
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for change in (0, 1, 10, 200):
            other = np.unique(np.concatenate([base[change:], rng.integers(0, 1 << 63, change, dtype=np.uint64)]))
            differ = len(np.setxor1d(base, other))
            bits = np.bitwise_count((near_dedup.parities(base) ^ near_dedup.parities(other)).view(np.uint64)).sum()
            assert bits <= differ and (differ > 100 or bits >= 0.7 * differ)


def test_family_of_near_misses(spark):
    """Variants of one text that lie around the threshold from each other: components equal those of all pairs."""
    from kgspark.llm import near_dedup

    rng = random.Random(21)
    base = [f"w{i}" for i in range(90)]
    texts = [" ".join(base)]
    for _ in range(260):
        t = list(base)
        for at in rng.sample(range(90), rng.randint(1, 4)):
            t[at] = f"x{rng.randrange(10 ** 6)}"
        texts.append(" ".join(t))
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for t in texts)]
    want = classes(range(len(texts)), lambda x, y: 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, shingle=3, percent=85).collect()}
    assert got == want and len(set(want.values())) > 20
