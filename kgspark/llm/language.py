"""Language identification by unigram pieces, with segmentations marginalised.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum, over all ways
to cut it into pieces, of the product of their probabilities (forward algorithm); of a text, the product over its words. The
language with the largest one is predicted; its score is its posterior under equal priors.

Words are runs of letters in lower case, opened by the vocabulary's word mark. Runs of over ``STRETCH`` letters are scored in
stretches of that length. A letter that is no piece has the same small probability in all languages.

Probabilities are learned by expectation-maximisation from a bounded sample: about ``SAMPLE_ROWS`` rows of each language, chosen by
hash. Everything else covers whole texts and all rows. Words are scored once per batch, for all languages at once; workers keep
the scores of the words met lately, at most ``RECENT``.

Defined results: a text that is null or has no letter is ``und`` with score 0; with nothing to learn from, all texts are; a null
language is not learned; a null id belongs to no held-out part; an empty table gives an empty result; other columns may have any
name; ties go to the smaller language name.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .core import lean, portions, query, table

UNKNOWN = "und"
MARK = "▁"  # opens a word in the vocabulary
LETTERS = re.compile(r"[^\W\d_]+")
STRETCH = 32
SAMPLE_ROWS = 3_000
ROUNDS = 2
SMOOTHING = 0.1
RECENT = 150_000
AT_ONCE = 20_000  # words scored together
OTHER = 1e-7  # a letter that is no piece
BASE = np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece file that consist of letters, with or without the word mark, in lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {p for i in range(model.get_piece_size()) if (p := model.id_to_piece(i).lower()).removeprefix(MARK).isalpha() or p == MARK}
    return sorted(found)


def parts_of(text: str) -> list[str]:
    """The words of a text as they are scored: marked, and in stretches."""
    out = []
    words = LETTERS.findall(text.lower())
    if not all(map(str.isalpha, words)):  # number signs count as word characters, but are no letters
        words = [w for word in words for w in "".join(c if c.isalpha() else " " for c in word).split()]
    for word in words:
        if len(word) < STRETCH:
            out.append(MARK + word)
        else:
            word = MARK + word
            out += [word[i : i + STRETCH] for i in range(0, len(word), STRETCH)]
    return out


class Pieces:
    """The vocabulary as sorted hashes per length, so that all words of a batch are looked up together."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        by_size = defaultdict(list)
        for i, p in enumerate(pieces):
            by_size[len(p)].append((p, i))
        self.by_size = {}
        for size, found in sorted(by_size.items()):
            codes = np.array([[ord(c) for c in p] for p, _ in found], np.uint64)
            h = self._hash(codes)[:, -1]
            order = np.argsort(h)
            self.by_size[size] = (h[order], np.array([i for _, i in found])[order])

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        """Hashes of all prefixes of each row."""
        out = np.zeros(codes.shape, np.uint64)
        h = np.zeros(len(codes), np.uint64)
        for j in range(codes.shape[1]):
            h = h * BASE + codes[:, j] + np.uint64(1)
            out[:, j] = h
        return out

    def lattice(self, words: list[str]) -> Iterator[tuple[np.ndarray, int, list[tuple[int, int, np.ndarray, np.ndarray]]]]:
        """Groups of words of equal length: which words, the length, and each place where pieces fit: (start, size, rows, piece ids)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        power = {size: np.power(BASE, np.uint64(size)) for size in self.by_size}
        for n in np.unique(sizes).tolist():
            of_size = np.flatnonzero(sizes == n)
            for rows in np.array_split(of_size, -(-len(of_size) // AT_ONCE)):
                yield rows, n, self._fits(words, rows, n, power)

    def _fits(self, words: list[str], rows: np.ndarray, n: int, power: dict) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        codes = np.frombuffer("".join(words[i] for i in rows).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(len(rows), n)
        h = np.concatenate([np.zeros((len(rows), 1), np.uint64), self._hash(codes)], axis=1)
        fits = []
        for start in range(n):
            for size, (keys, ids) in self.by_size.items():
                if start + size > n:
                    break
                wanted = h[:, start + size] - h[:, start] * power[size]
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == wanted)
                if len(hit):
                    fits.append((start, size, hit, ids[at[hit]]))
        return fits


class Model:
    """Log scores of words under every language."""

    def __init__(self, languages: list[str], pieces: Pieces, p: np.ndarray):
        self.languages, self.pieces, self.p = languages, pieces, p
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(languages)))

    def __getstate__(self):
        return self.languages, self.pieces, self.p

    def __setstate__(self, state):
        self.__init__(*state)

    def forward(self, rows: np.ndarray, n: int, fits: list) -> np.ndarray:
        """``alpha[j]``: the summed probability of all ways to cut the first j letters."""
        alpha = np.zeros((n + 1, len(rows), len(self.languages)))
        alpha[0] = 1.0
        at = 0
        for start in range(n):
            alpha[start + 1] += alpha[start] * OTHER
            while at < len(fits) and fits[at][0] == start:
                _, size, hit, ids = fits[at]
                alpha[start + size][hit] += alpha[start][hit] * self.p[ids]
                at += 1
        return alpha

    def log_scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        for rows, n, fits in self.pieces.lattice(words):
            out[rows] = np.log(self.forward(rows, n, fits)[n])
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """How often each piece is used, expected over all ways to cut the words; ``counts[word, language]``."""
        used = np.zeros(self.p.shape)
        for rows, n, fits in self.pieces.lattice(words):
            alpha = self.forward(rows, n, fits)
            beta = np.zeros_like(alpha)
            beta[n] = 1.0
            weight = counts[rows] / alpha[n]
            at = len(fits) - 1
            for start in range(n - 1, -1, -1):
                beta[start] += beta[start + 1] * OTHER
                while at >= 0 and fits[at][0] == start:
                    _, size, hit, ids = fits[at]
                    through = self.p[ids] * beta[start + size][hit]
                    beta[start][hit] += through
                    np.add.at(used, ids, alpha[start][hit] * through * weight[hit])
                    at -= 1
        return used

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if len(self.known) > RECENT:
            self.known = {}
        split = [parts_of(t) for t in texts]
        new = list({w for words in split for w in words if w not in self.known})
        if not self.known:
            self.scores = np.zeros((0, len(self.languages)))
        start = len(self.scores)
        self.scores = np.concatenate([self.scores, self.log_scores(new)])
        self.known.update(zip(new, range(start, start + len(new))))
        names, sure = [], []
        for words in split:
            if not words or not self.languages:
                names.append(UNKNOWN)
                sure.append(0.0)
                continue
            total = self.scores[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)
            best = int(total.argmax())
            names.append(self.languages[best])
            sure.append(float(1.0 / np.exp(np.minimum(total - total[best], 0.0)).sum()))
        return names, sure


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from: a quarter, by checksum of the id. A null id is not among them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", vocabulary_path: str | None = None, sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> Model:
    """A model of the languages in ``labelled``. About ``sample_rows`` rows of each language are read, the same ones each time."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as the data has names of languages
    languages = sorted(sizes)
    pieces = Pieces(read_pieces(vocabulary_path or default_vocabulary()))
    p = np.full((pieces.n, len(languages)), 1.0 / pieces.n)
    if not languages:
        return Model(languages, pieces, p)
    n = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("lang"))
    chance = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(chance * n < sample_rows).dropDuplicates(["lang", "text"])
    number = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[lang].update(parts_of(text))
        for lang, words in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(words)), pa.array([number[lang]] * len(words), pa.int32()), pa.array(list(words.values()), pa.int64())], ["word", "lang", "n"])

    counts = cut_lineage(sample.mapInArrow(count, "word string, lang int, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")))
    spark = labelled.sparkSession
    for _ in range(rounds):
        model = spark.sparkContext.broadcast(Model(languages, pieces, p))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, used = model.value, np.zeros((pieces.n, len(languages)))
            for batch in batches:
                words = batch.column(0).to_pylist()
                weight = np.zeros((len(words), len(languages)))
                weight[np.arange(len(words)), batch.column(1).to_numpy()] = batch.column(2).to_numpy()
                used += m.expected(words, weight)
            at, lang = np.nonzero(used)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(lang, pa.int64()), pa.array(used[at, lang])], ["piece", "lang", "n"])

        found = counts.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()  # pieces x languages
        p = np.full((pieces.n, len(languages)), SMOOTHING)
        p[found["piece"].to_numpy(), found["lang"].to_numpy()] += found["n"].to_numpy()
        p /= p.sum(axis=0)
    return Model(languages, pieces, p)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``row`` (the other columns of ``docs``), ``text, lang_pred, score``; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sure = [], []
            for some in portions(t.as_py() or "" for t in batch.column(1)):
                told = shared.value.predict(some)
                names += told[0]
                sure += told[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(sure, pa.float64())], ["row", "text", "lang_pred", "score"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"), F.col(text_col).alias("text"))
    return packed.mapInArrow(lean(run), T.StructType([*packed.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language can be told, with the predicted language as ``lang_col``; a text that is null or has no letter goes."""
    told = identify(docs, learn(docs.filter(~held_out(id_col)), text_col), text_col).filter(F.col("lang_pred") != UNKNOWN)
    own = {text_col: F.col("text"), lang_col: F.col("lang_pred")}
    return told.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


@query("op3_language")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(~held_out()))
    out = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.select(F.col("row.doc_id").alias("doc_id"), F.col("row.held_out").alias("held_out"), "lang_pred", "score")
