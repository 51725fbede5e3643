"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables and odd column names, against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.llm import bpe, components, exact_dedup, html_text, language, licenses, metric_search, mixing, near_dedup, secrets, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, digest string, words string"


def docs_of(spark, texts, lang="en", source="a"):
    rows = [(i, t, lang, source, 0, "r", "d", "w") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    base, passage = prose(120), prose(110)
    out = [base, base, base + " ", base.replace(base.split()[60], "zzz"), None, "", " \t\n", "one", "one two", "A.", "<|endoftext|>" + prose(5), "é" * 500, passage + prose(70), prose(70) + passage, prose(4000), "1234"]
    out += [prose(rng.randint(1, 90)) for _ in range(20)]
    out += [" ".join(w if rng.random() > 0.03 else "x" + w for w in base.split()) for _ in range(12)]
    return out + out[-3:]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup_with_weak_digests(spark, texts):
    docs = docs_of(spark, texts)
    want = defaultdict(list)
    for i, t in enumerate(texts):
        want[t or ""].append(i)
    for digest in (exact_dedup.sha256, lambda t: F.length(t).cast("string").cast("binary")):  # the second one clashes
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.copies(docs, digest=digest).collect()}
        assert got == {i: (max(want[t or ""]), len(want[t or ""]), i == max(want[t or ""])) for i, t in enumerate(texts)}
    kept = exact_dedup.keep_one(docs.union(docs))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(max(v) for v in want.values())
    assert exact_dedup.copies(empty(spark)).count() == 0 and exact_dedup.keep_one(empty(spark)).count() == 0


def test_mixing_meets_targets(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", [None, "", "b", "c"][i % 4], 0, "r", "d", "w") for i, t in enumerate(texts)], SCHEMA)
    made = mixing.mix(docs, block_words=50, shard_words=500)
    size = {i: len((t or "").split()) for i, t in enumerate(texts)}
    weight = {"": 3.0, "b": 1.0, "c": 2.0, None: 3.0}
    total = {s: sum(n for i, n in size.items() if [None, "", "b", "c"][i % 4] == s) for s in weight}
    left, open_, target = 1.5 * sum(total.values()), set(weight), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * total[s]}
        for s in full or open_:
            target[s] = 2.0 * total[s] if full else weight[s] * level
            left -= target[s] if full else 0
        open_ = open_ - full if full else set()
    taken, shards = Counter(), set()
    for r in made.pieces.collect():
        taken[r["doc_id"]] += r["words"]
        shards.add(r["shard"])
        assert 0 <= r["first"] and r["first"] + r["words"] <= r["size"]
    assert len(shards) > 1
    for r in made.documents.collect():
        s = [None, "", "b", "c"][r["doc_id"] % 4]
        assert r["size"] == size[r["doc_id"]] and r["target"] == pytest.approx(target[s]) and taken[r["doc_id"]] <= 2 * r["size"]
    for s in weight:
        assert abs(sum(n for i, n in taken.items() if [None, "", "b", "c"][i % 4] == s) - target[s]) <= 1
    rows = mixing.mixed_documents(docs, block_words=50, shard_words=500)
    assert rows.columns == docs.columns
    words = Counter()
    for r in rows.collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert words == Counter({i: n for i, n in taken.items() if n})
    assert mixing.mix(empty(spark)).documents.count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0


def test_mixing_reports_every_row_without_words(spark):
    docs = spark.createDataFrame([(1, t, "en", "b", 0, "r", "d", "w") for t in ("", "", "", None, None, " ")] + [(2, "one two three", "en", "b", 0, "r", "d", "w")], SCHEMA)
    got = Counter((r["doc_id"], r["size"]) for r in mixing.taken(mixing.mix(docs, block_words=50, shard_words=500)).collect())
    assert got == {(1, 0): 6, (2, 3): 1}


def test_shard_quotas_split_every_block_once(spark):
    q = spark.createDataFrame([(1, 70, 7000), (2, 30, 3000), (3, 1, 100)], "source_no int, quota long, words long")
    rows = mixing.shard_quotas(q, 1, 1300).collect()
    for s, n in ((1, 70), (2, 30), (3, 1)):
        runs = sorted((r["begin"], r["end"]) for r in rows if r["source_no"] == s)
        assert runs[0][0] == 0 and max(e for _, e in runs) == n and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))
    per = Counter()
    for r in rows:
        per[r["shard"]] += r["end"] - r["begin"]
    assert len(per) == 8 and max(per.values()) - min(per.values()) <= 2


def test_forward_sums_all_segmentations():
    pieces = language.Pieces(sorted(["a", "b", "ab", "ba", "▁a", "aba", "▁"]))
    model = language.Model(["x", "y"], pieces, np.random.default_rng(1).random((pieces.n, 2)))
    ids = {p: i for i, p in enumerate(sorted(["a", "b", "ab", "ba", "▁a", "aba", "▁"]))}

    def ways(w):
        if not w:
            return np.ones(2)
        return language.OTHER * ways(w[1:]) + sum(model.p[ids[w[:n]]] * ways(w[n:]) for n in range(1, len(w) + 1) if w[:n] in ids)

    words = ["▁abab", "▁b", "▁abc", "▁", "▁bababa"]
    assert np.allclose(np.exp(model.log_scores(words)), [ways(w) for w in words])
    # expected uses times pieces' lengths, with the letters that are no piece, cover every letter
    used = model.expected(["▁aab"], np.ones((1, 2)))
    assert np.all(used >= 0) and np.all((used * np.array([[len(p)] for p in sorted(ids)])).sum(axis=0) <= 4 + 1e-9)


def test_language(spark):
    sf = "/root/testdata/sf0.001/documents.parquet"
    docs = spark.read.parquet(sf).select("doc_id", "text", "lang")
    more = spark.createDataFrame([(10**6, None, None), (10**6 + 1, "", "en"), (10**6 + 2, "123 ²½ !!", "en"), (None, "the " * 9000, None)], docs.schema)
    docs = docs.union(more)
    model = language.learn(docs.filter(~language.held_out()))
    got = {r["row"]["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert all(got[10**6 + i]["lang_pred"] == "und" for i in range(3)) and got[None]["lang_pred"] == "en"
    held = [r for r in docs.filter(language.held_out() & F.col("lang").isNotNull() & (F.length("text") > 40)).collect()]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(empty(spark), model).count() == 0
    nothing = language.learn(empty(spark))
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}


def test_bpe_equals_the_library(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    rng = random.Random(3)
    odd = ["".join(rng.choice("ab  \n\t'sdtll1²½é_€你😀.,-́\x1c\x85\xa0　") for _ in range(rng.randint(1, 60))) for _ in range(150)] + ["a" * 3000, "<|endoftext|><|endoftext|>x"]
    docs = docs_of(spark, [*texts, *odd])
    for words in (40, 100_000):
        lexicon = bpe.build_lexicon(docs, words=words)
        got = {r["row"]["doc_id"]: r for r in bpe.encode(docs, lexicon, decoded=True).collect()}
        for i, t in enumerate([*texts, *odd]):
            ids = library.encode(t or "", add_special_tokens=False).ids
            assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids
            assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
    back = bpe.decode(bpe.encode(docs, lexicon).select("row.doc_id", "ids"), lexicon)
    assert {r["row"]["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate([*texts, *odd])}
    assert bpe.encode(empty(spark), bpe.build_lexicon(empty(spark))).count() == 0


def test_transducer_is_minimal_and_exact():
    from kgspark.llm.transducer import Transducer

    rng = random.Random(1)
    words = sorted({bytes(rng.choice(b"ab\xff") for _ in range(rng.randint(0, 7))) for _ in range(400)})
    t = Transducer.compile(words)
    asked = words + [b"abababababa", b"c", b"ab\xff\xff\xff\xff\xff\xff"]
    assert t.places(asked).tolist() == [words.index(w) if w in words else -1 for w in asked]
    suffixes = {frozenset(w[len(p):] for w in words if w.startswith(p)) for x in words for p in (x[:i] for i in range(len(x) + 1))}
    assert len({k // 257 for k in t.arcs[0].tolist()}) == len(suffixes)


def sets_of(texts, n):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


def test_near_dedup(spark, texts):
    sets, label = sets_of(texts, 3), list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    docs = docs_of(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs, shingle=3, percent=85).collect()}
    assert got == {i: (len(sets[i]), label[i], label[i] == i) for i in range(len(texts))}
    kept = near_dedup.keep_one(docs, shingle=3, percent=85)
    assert sorted(kept.columns) == sorted(docs.columns) and sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(len(texts)) if label[i] == i]
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_links_that_no_star_finds(spark, texts):
    """The second, exact search alone finds all links between different components."""
    docs = docs_of(spark, texts)
    alone = docs.filter("length(trim(text)) > 0").select("doc_id", F.col("doc_id").alias("component"))
    pairs = near_dedup._prefix_pairs(alone, docs.select("doc_id", "text"), 3, 85)
    got = {(r["a"], r["b"]) for r in near_dedup.confirmed(pairs, docs.select("doc_id", "text"), 3, 85).collect()}
    sets = sets_of(texts, 3)
    assert got == {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b and 100 * len(a & b) >= 85 * len(a | b)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 200), (300, 300)] + [(500, i) for i in range(501, 530)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200, **{i: 500 for i in range(500, 530)}}


def _check_repeats(spark, texts):
    seen = Counter()
    raws = [(t or "").encode() for t in texts]
    for b in raws:
        seen.update(b[p:p + 400] for p in range(len(b) - 399))
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs_of(spark, texts)).collect()}
    removed = 0
    for i, b in enumerate(raws):
        off = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if seen[b[p:p + 400]] > 1:
                off[p:p + 400] = True
        kept = np.frombuffer(b, np.uint8)[~off].tobytes()
        runs = int((np.diff(np.concatenate([[0], off.astype(int)])) == 1).sum())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (len(b), int(off.sum()), runs, kept)
        removed += int(off.sum())
    return removed


def test_suffix_dedup(spark, texts):
    assert _check_repeats(spark, texts) > 0
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_suffix_dedup_at_edges(spark):
    rng = random.Random(11)

    def prose(n):
        return "".join(rng.choice("abcdefghij ") for _ in range(n))

    base = prose(3000)
    out = [base]
    for _ in range(40):  # pieces of one passage that start and end anywhere, so that edges meet edges, inner parts and each other
        lo = rng.randrange(2500)
        out.append(prose(rng.randrange(300)) + base[lo : lo + rng.randint(380, 900)] + prose(rng.randrange(300)))
    for _ in range(30):  # copies that differ at a few places
        t = list(base)
        for _ in range(rng.randint(1, 6)):
            t[rng.randrange(len(t))] = "#"
        out.append("".join(t))
    twin = prose(400)
    out += [twin + "x" + prose(50), "y" + twin, base[:399], base[:400], base[5:405] * 2, "ab" * 700, "ab" * 500 + "c", "a" * 399, "z" * 400, "z" * 401, "é" * 250 + prose(200) + "é" * 250]
    out += [out[3]] * 3 + [prose(500) for _ in range(5)]
    assert _check_repeats(spark, out) > 0


def test_metric_search(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 6)]) for i in range(400)] + [(400 + i, [0.5] * 6) for i in range(120)]
    rows += [(600, None), (601, [1.0, None]), (602, [float("nan")] * 6), (603, []), (604, []), (605, [1.0, 2.0]), (None, [0.1] * 6), (606, [float("inf")] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = frame.filter(metric_search.usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), metric_search.integers(F.col("embedding")).alias("v"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in metric_search.search(metric_search.build(v, routes=7, page=30), v.filter("id % 20 = 0 or id = 603"), 5, block=9).collect()}
    known = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    want = {}
    for q in known:
        if q % 20 == 0 or q == 603:
            best = sorted((-sum(a * b for a, b in zip(known[q], e)), i) for i, e in known.items() if i != q and len(e) == len(known[q]))[:5]
            want |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(best)}
    assert got == want
    assert metric_search.search(metric_search.build(v.filter("false")), v.filter("false"), 5).count() == 0


def test_html_text(spark):
    page = ('<html><head><title>T</title><script>var a="</p>"; if (a<b && c) {}</script></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy</div>'
            "<article><h1>Head &amp; more</h1><p><b>One <i>two</i><br>three\n four<p>Fi&eacute;ve <!-- no --> x</p></article><div id='comments'><p>Me too</p></div><footer>&copy;</footer></body></html>")
    other = '<body><div class="menu-1"><p>skip</p></div><div class="post-12 text"><p>A long paragraph of running text, the article.</p><p>More.</p></div><aside>no</aside>'
    rows = [(0, "http://x.org/1", page, "r"), (1, None, other, "r"), (2, "http://x.org/2", None, "r"), (3, "http://x.org/3", "", "r"), (4, "bad", "plain text", "r"), (0, "http://x.org/1", page, "r")]
    got = [(r["row"]["page_id"], r["text"]) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, row string")).collect()]
    assert sorted(got) == sorted([(0, "Head & more\nOne two three four\nFiéve x")] * 2 + [(1, "A long paragraph of running text, the article.\nMore."), (2, ""), (3, ""), (4, "plain text")])
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_names_do_not_hide_articles():
    story = "<p>" + "The article has a long paragraph of running text. " * 4 + "</p>"
    text = " ".join(("The article has a long paragraph of running text. " * 4).split())
    for name in ("has-sidebar", "container with-sidebar", "no-sidebar", "page-with-nav", "elementor-widget-text-editor", "post legal"):
        page = html_text.Page(f'<body><div class="{name}"><h1>Head</h1>{story}</div><div class="ad"><p>Buy now</p></div></body>')
        assert page.text(page.best()) == "Head\n" + text, name
    short = html_text.Page('<body><div class="with-nav"><article><p>Short.</p></article></div><div><p>' + "Other text. " * 20 + "</p></div></body>")
    assert "Short." in short.text(None)
    assert html_text.Page('<div class="notice"><p>Only this</p></div>').text(None) == "Only this"
    talk = html_text.Page(f'<body><div class="wrap"><div class="post">{story}</div></div><div class="comments"><p>{"Me too, I say. " * 8}</p></div></body>')
    assert talk.text(talk.best()) == text
    inner = html_text.Page(f'<body class="x"><article>{story}<div class="share"><p>Share it</p></div></article></body>')
    assert inner.text(inner.best()) == text


def test_html_leaves_out_comments_and_adverts_of_any_length():
    story, talk = "<p>A short story of the day.</p>", f"<p>{'Me too, I say, and more. ' * 20}</p>"
    for source in (f'<article>{story}<div class="comments">{talk}</div></article>', f'<main>{story}<section id="comments">{talk}</section></main>',
                   f'<body><div class="post">{story}<div class="advert">{talk}</div></div></body>',
                   f'<article>{story}<div class="comments"><article class="comment-body">{talk}</article></div></article>',
                   f'<article>{story}<div class="comments"><article>{talk}</article></div></article>'):
        page = html_text.Page(source)
        path = min((p for p, _, _ in page.blocks), key=len)
        assert page.text(path) == "A short story of the day.", source
    head = html_text.Page(f"<header><h1>Site</h1></header><article><header><p>By x</p><h1>The <i>head</i></h1><p>today</p></header>{story}<footer><h2>No</h2></footer></article>")
    assert head.text(head.best()) == "The head\nA short story of the day."
    deep = html_text.Page("<div>" * 3000 + story + "</div>" * 1000 + talk)
    assert deep.text(()).startswith("A short story of the day.\nMe too")


def test_near_dedup_tells_long_words_apart():
    a, b = "a", "b"
    for _ in range(11):  # sums modulo 2^64 over these two cancel
        a, b = a + b, b + a
    assert near_dedup.shingle_set(f"{a} x y", 3)[0] != near_dedup.shingle_set(f"{b} x y", 3)[0]
    assert (near_dedup.shingle_set(f"{a.upper()} x y", 3) == near_dedup.shingle_set(f"{a} X y", 3)).all()


def test_html_layouts_of_one_host(spark):
    def page(n, kind, teaser=""):
        return f'<body><div class="{teaser or "x"}"><p>Teaser {n}.</p></div><div class="{kind}"><p>{f"Article {n} in its own container. " * 5}</p></div></body>'

    kinds = [f"layout-{c}" for c in "abcdefghijkl"]  # more than the eight paths that a host once kept
    sources = [page(n, kinds[0]) for n in range(30)] + [page(100 + n, k, kinds[0]) for n, k in enumerate(kinds[1:])]
    # a page with a longer container of its own follows the host
    sources.append('<body><div class="layout-a"><p>' + "The article of this page. " * 5 + '</p></div><div class="once"><p>' + "Me too and more. " * 10 + "</p></div></body>")
    rows = [(i, "http://y.org/" + str(i) if i % 2 else None, s) for i, s in enumerate(sources[:-1])] + [(len(sources) - 1, None, sources[-1])]
    got = {r["row"]["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(sources) and all(got[i].startswith("Article") for i in range(len(sources) - 1)), got
    assert got[len(sources) - 1].startswith("The article of this page.")


def test_secrets(spark):
    rng = random.Random(4)

    def value(n, kinds="0123456789abcdef"):
        return "".join(rng.choice(kinds) for _ in range(n))

    texts = [f'some words token = "{value(40)}" and more' for _ in range(60)] + [f"call {value(16, '0123456789')} now or {value(4)}.someone12@mail.example.com today" for _ in range(60)]
    texts += [None, "", "no finding here", 'x token = "' + "a1" * 20 + '" y token = "' + "a1" * 20 + '"']
    got = secrets.scan(docs_of(spark, texts)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert all(len(by[i]) == 1 and by[i][0]["secret"] for i in range(60))
    assert not any(r["secret"] for i in range(60, 120) for r in by[i]) and all(by[i] for i in range(60, 120))
    assert by[123][0]["times"] == 2 and texts[123][by[123][0]["at"] - 1:].startswith("a1a1")
    assert not {120, 121, 122} & set(by) and secrets.scan(empty(spark)).count() == 0


def test_secrets_short_values_and_keys_without_digits(spark):
    rng = random.Random(8)
    key = "AKIA" + "QWERTYUIOPASDFGH"
    want = {0: 'set password="Summer2024!" now', 1: 'password = "correct-Horse!battery$staple9"', 2: f"uses {key} here", 3: "Password: hunter2, then", 4: "a qwertyUIOPasdfghjkl b",
            5: "pwd: token = 'x y'", 6: '{"secret": "p\\"q"}', 7: "DB_PASSWORD=pa$$w0rd!#", 8: "passwd=ab", 9: 'pwd="(x)" and "y"'}
    value = {0: "Summer2024!", 1: "correct-Horse!battery$staple9", 2: key, 3: "hunter2", 4: "qwertyUIOPasdfghjkl", 5: "x y", 6: 'p\\"q', 7: "pa$$w0rd!#", 8: "ab", 9: "(x)"}
    got = defaultdict(dict)
    for r in secrets.findings(docs_of(spark, [want[i] for i in sorted(want)])).collect():
        got[r["doc_id"]][r["candidate"]] = r
        assert want[r["doc_id"]][r["at"] - 1:].startswith(r["candidate"]) and r["times"] == 1
    for i in want:
        assert value[i] in got[i], (i, set(got[i]))
    assert {i: set(got[i]) for i in (0, 1, 2, 3, 6, 7, 8, 9)} == {i: {value[i]} for i in (0, 1, 2, 3, 6, 7, 8, 9)}
    kinds = "abcdefghijkmnpqrstuvwxyzABCDEFGH23456789!#$%&*"
    texts = [f'some words password = "{"".join(rng.choice(kinds) for _ in range(9))}" and more' for _ in range(80)] + ["we call donaudampfschifffahrt often and more" for _ in range(80)]
    by = {r["doc_id"]: r["secret"] for r in secrets.scan(docs_of(spark, texts)).collect()}
    assert all(by[i] for i in range(80)) and not any(by[i] for i in range(80, 160))


def test_licenses(spark):
    rng = random.Random(6)
    filler = [f"w{i}" for i in range(200)]

    def prose(n):
        return " ".join(rng.choice(filler) for _ in range(n))

    whole = licenses.TEMPLATES
    long = whole["MIT (text)"].split()
    damaged = " ".join(w for i, w in enumerate(long) if i not in (20, 70))  # ten of its shingles are gone
    half = " ".join(long[: len(long) // 2])
    texts = [prose(30) + " " + t + " " + prose(50) for t in whole.values()] + [prose(77) + " " + damaged + " " + prose(3), prose(9) + half, None, "", "MIT", prose(3000), "the license", "RELEASED under the mit license"]
    got = defaultdict(set)
    for r in licenses.scan(docs_of(spark, texts)).collect():
        got[r["doc_id"]].add(r["license"])

    def grams(t):
        w = licenses.template_words(t or "")
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    for i, t in enumerate(texts):
        assert got[i] == {n for n, x in whole.items() if len(grams(x) & grams(t)) >= licenses.CONTAINED * len(grams(x))}, (i, t)
    assert licenses.scan(empty(spark)).count() == 0


def test_licenses_whole_texts_and_notices(spark):
    body = {p.stem: p.read_text() for p in licenses.TEXTS.glob("*.txt")}
    mit = body["MIT"].split("\n\n")[-1]
    want = [("some words licensed under the MIT License today", "MIT"), ("see CC BY-NC-SA 4.0 for terms", "CC-BY-NC-SA-4.0"), ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"),
            ("under the GNU Affero General Public License, version 3, as is", "AGPL-3.0"), ("a b " + mit, "MIT (text)"), ("released under CC0 1.0", "CC0-1.0")]
    want += [("x y z " + body[n] + " and more", n + " (text)") for n in body]
    want += [(body[n][len(body[n]) // 2:], n + " (text)") for n in ("Apache-2.0", "GPL-3.0", "BSD", "EPL-1.0", "LGPL-2.1", "Unlicense")]
    got = defaultdict(set)
    for r in licenses.scan(docs_of(spark, [t for t, _ in want])).collect():
        got[r["doc_id"]].add(r["license"])
    for i, (t, name) in enumerate(want):
        assert name in got[i], (name, got[i], t[:80])
    assert got[0] == {"MIT"} and got[1] == {"CC-BY-NC-SA-4.0"} and got[2] == {"GPL-2.0"}
    twice = docs_of(spark, ["the BSD  License"] * 2)
    assert [r["license"] for r in licenses.scan(twice.union(twice)).collect()] == ["BSD"] * 4
    own = licenses.scan(docs_of(spark, ["foo gplx bar", "gply", "one GPLX two"]), {"own": "GPLX", "none": ""}).collect()
    assert sorted((r["doc_id"], r["license"], r["containment"], r["at_word"]) for r in own) == [(0, "own", 1.0, 1), (2, "own", 1.0, 1)]


def test_pipeline_stages_keep_the_columns(spark, texts):
    import corpus_pipeline

    docs = docs_of(spark, texts).drop("row", "digest", "words")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(ids) == docs.count() and all(r["decoded_sha256"] for r in ids)
    text = Counter(hashlib.sha256(r["text"].encode()).hexdigest() for r in docs.collect())
    assert text == Counter(r["decoded_sha256"] for r in ids)


def test_encoder_looks_at_every_word_once():
    from kgspark.llm.bpe import Words

    words = Words()
    assert list(map(words.__getitem__, ["a", "b", "a"])) == [-1, -2, -1] and words.fresh == ["a", "b"]
    words.fresh, words["a"] = [], 7
    assert words["a"] == 7 and words["c"] == -1 and words.fresh == ["c"]
