"""The pipeline against a brute-force twin of its stages."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

ALPHABET = {"en": "abcdeh", "ru": "абвгде"}


@pytest.fixture(scope="module")
def corpus():
    """``doc_id -> text, lang, source``; two languages told apart by their letters, copies, near copies, texts without letters."""
    rng = random.Random(12)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(300)] for lang, letters in ALPHABET.items()}

    def prose(lang, n):
        return " ".join(rng.choice(words[lang]) for _ in range(n))

    docs = {}
    for i in range(120):
        lang = ("en", "ru")[i % 2]
        docs[i] = (prose(lang, rng.randint(5, 120)), None if i % 7 == 0 else lang, (None, "a", "b", "c")[i % 4])
    for i in range(20):
        docs[200 + i] = docs[i]
    for i in range(20, 40):
        text = docs[i][0].split()
        if len(text) > 60:
            docs[300 + i] = (" ".join([*text[:-1], "x"]), docs[i][1], docs[i][2])
    docs |= {500: (None, None, "a"), 501: ("", "en", None), 502: ("1234 !?", "en", "b"), 503: ("  \n", None, "c")}
    return docs


def twin(docs):
    """The ids that the first three stages keep."""
    kept = {i: d for i, d in docs.items() if any(c.isalpha() for c in d[0] or "")}
    last = {}
    for i, d in kept.items():
        last[d[0]] = max(i, last.get(d[0], i))
    kept = {i: d for i, d in kept.items() if last[d[0]] == i}

    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {i: shingles(d[0]) for i, d in kept.items()}
    group = {i: i for i in sets}
    for _ in sets:
        for x in sets:
            for y in sets:
                if group[x] < group[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                    group[y] = group[x]
    return {i: d for i, d in kept.items() if group[i] == i}


def test_pipeline_equals_its_twin(spark, corpus, tmp_path):
    rows = [(i, t, lang, source, len(t or ""), "extra", "extra") for i, (t, lang, source) in corpus.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = twin(corpus)
    assert len(kept) < len([d for d in corpus.values() if d[0]])
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    taken = {}
    for r in got:
        text, lang, source = kept[r["doc_id"]]
        assert r["lang"] == ("en", "ru")[r["doc_id"] % 2] and r["source"] == source
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        own = library.decode(ids, skip_special_tokens=False)
        assert own in text + " " + text and ids == library.encode(own, add_special_tokens=False).ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest() and r["decoded_sha256"] == hashlib.sha256(own.encode()).hexdigest()
        taken.setdefault(r["doc_id"], []).append(len(own.split()))
    size = {i: len(d[0].split()) for i, d in kept.items()}
    assert all(sum(n) <= 2 * size[i] for i, n in taken.items())
    weight = {"a": 3.0, "b": 1.0, "c": 2.0, None: 3.0}  # by code point, null last
    total = {s: sum(size[i] for i, d in kept.items() if d[2] == s) for s in weight}
    left, open_, target = 1.5 * sum(total.values()), set(weight), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
        left, open_ = left - sum(target[s] for s in over), open_ - over
    for s in weight:
        assert abs(sum(sum(n) for i, n in taken.items() if kept[i][2] == s) - target[s]) <= 1


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
