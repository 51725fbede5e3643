"""Byte-pair encoding and decoding with a transducer lexicon.

Frequent words (pre-tokens) of the whole corpus are counted in Spark, encoded once, and compiled into a minimal acyclic transducer
whose outputs lead to their ids. The automaton is a file that Spark ships to every executor, where workers map it into memory. A
word that the lexicon lacks is merged exactly, pair by pair; so the lexicon changes the time, never the ids. Workers keep the
words they met lately, up to ``RECENT`` of them.

The rules are those of the byte-level vocabulary file: added tokens are cut out of the text first, the rest is split by the
pattern below, each word's bytes are merged by rank. Decoding concatenates the bytes of the ids and reads them as UTF-8.

Defined results: a null or empty text has no ids and decodes to an empty text; ids and repeated rows do not matter, there is one
row per row; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ensure_checkpoint_dir
from .core import lean, portions, query, table
from .transducer import Transducer

LEXICON_WORDS = 50_000
RECENT = 150_000
RECENT_CHARS = 8 << 20  # and of at most so many characters
PORTION = 1 << 18  # characters that a worker encodes at a time
FLUSH = 200_000  # distinct words that a counting task holds before it hands them on
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
PATTERN = regex.compile(CONTRACTIONS + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# the same classes among the first 256 code points, for texts that hold no others
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r" \t\n\x0b\f\r\x85\xa0"
LATIN = re.compile(rf"{CONTRACTIONS}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def words_of(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return PATTERN.findall(text)
    return LATIN.findall(text)


class Vocabulary:
    """Merge ranks and the bytes of every id, read from a byte-level BPE file. Small (the file's size); it is broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # printable bytes stand for themselves, the others for code points from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ids = {bytes(chars[c] for c in piece): i for piece, i in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.single = [ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = (bytes(chars[c] for c in x) for x in (left, right))
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.pieces: list[bytes] = [b""] * (max([*ids.values(), *self.added.values()]) + 1)
        for piece, i in ids.items():
            self.pieces[i] = piece
        for piece, i in self.added.items():
            self.pieces[i] = piece.encode()

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: again and again the pair of lowest rank, leftmost first, becomes one id.

        Long words keep their pairs in a heap, so they take n log n steps.
        """
        ids = [self.single[b] for b in word]
        if len(ids) > 64:
            return self._merge_long(ids)
        get = self.merges.get
        pairs = [get(p) for p in zip(ids, ids[1:])]
        while True:
            best, at = None, -1
            for i, m in enumerate(pairs):
                if m is not None and (best is None or m[0] < best[0]):
                    best, at = m, i
            if best is None:
                return ids
            ids[at : at + 2] = [best[1]]
            del pairs[at]
            if at:
                pairs[at - 1] = get((ids[at - 1], ids[at]))
            if at < len(pairs):
                pairs[at] = get((ids[at], ids[at + 1]))

    def _merge_long(self, ids: list[int]) -> list[int]:
        from heapq import heapify, heappop, heappush

        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapify(heap)
        gone = [False] * n
        while heap:
            _, i, a, b, new = heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], after[i] = new, True, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := self.merges.get((ids[x], ids[y]))):
                    heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
        return [x for x, off in zip(ids, gone) if not off]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word (binary), n``: how often each word stands in all texts. Tasks hand on partial counts; Spark adds them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.encode() for w in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                seen.update(words_of(text.as_py() or ""))
                if len(seen) > FLUSH:
                    yield handed()
        yield handed()

    parts = docs.select(F.col(text_col).alias("text")).filter("text <> ''").mapInArrow(lean(count), "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class Words(dict):
    """Words and their places; a word looked up for the first time is noted in ``fresh`` and has its number there, negative and from -1, until it is learnt."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = place = -len(self.fresh)
        return place


class Lexicon:
    """What a worker needs to encode: the vocabulary, the file of the automaton, and the ids of its words end to end."""

    def __init__(self, vocabulary: Vocabulary, file: str, ids: np.ndarray, sizes: np.ndarray):
        self.vocabulary, self.file, self.ids, self.sizes = vocabulary, file, ids, sizes
        self.words = Words()

    def __getstate__(self):
        return self.vocabulary, self.file, self.ids, self.sizes

    def __setstate__(self, state):
        self.__init__(*state)

    def _start(self) -> None:
        """Begin the worker's table of recent words with the lexicon's ids, and empty it when it is full."""
        if not hasattr(self, "automaton"):
            self.automaton = Transducer.open(SparkFiles.get(self.file))
            self.piece_sizes = np.fromiter(map(len, self.vocabulary.pieces), np.int64)
            self.piece_bytes = np.frombuffer(b"".join(self.vocabulary.pieces), np.uint8)
            self.piece_first = np.cumsum(self.piece_sizes) - self.piece_sizes
            self.split = re.compile("|".join(map(re.escape, sorted(self.vocabulary.added, key=len, reverse=True)))) if self.vocabulary.added else None
        self.words, self.chars = Words(), 0
        self.flat, self.used = np.concatenate([self.ids, np.zeros(4 * RECENT, np.uint32)]), len(self.ids)
        self.first, self.count = (np.zeros(len(self.sizes) + RECENT, np.int64) for _ in range(2))
        self.entries = len(self.sizes)
        self.count[: self.entries] = self.sizes
        self.first[: self.entries] = np.cumsum(self.sizes) - self.sizes

    def _learn(self) -> np.ndarray:
        """Give each fresh word an entry: its lexicon entry if it has one, else one of its own, merged now. → their places"""
        new, self.words.fresh = self.words.fresh, []
        raw = [w.encode() for w in new]
        self.chars += sum(map(len, new))
        places = self.automaton.places(raw).tolist()
        for i, place in enumerate(places):
            if place < 0:
                places[i] = self._enter(self.vocabulary.merge(raw[i]))
        self.words.update(zip(new, places))
        return np.array(places, np.int64)

    def _enter(self, ids: list[int]) -> int:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat) // 2, len(ids)), np.uint32)])
        if self.entries == len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros(len(x) // 2 + 1, np.int64)]) for x in (self.first, self.count))
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[self.entries], self.count[self.entries] = self.used, len(ids)
        self.used += len(ids)
        self.entries += 1
        return self.entries - 1

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > RECENT or not hasattr(self, "automaton") or self.chars > RECENT_CHARS:
            self._start()
        added = self.vocabulary.added
        split: list[list[str]] = []
        for text in texts:
            if self.split and self.split.search(text):
                words, at = [], 0
                for m in self.split.finditer(text):
                    words += [*words_of(text[at : m.start()]), "\0" + m[0]]
                    at = m.end()
                split.append(words + words_of(text[at:]))
                if "\0" + m[0] not in self.words:
                    self.words |= {"\0" + t: self._enter([i]) for t, i in added.items()}
            else:
                split.append(words_of(text))
        # one look at every word: those that are fresh get their places afterwards
        found = [np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)) for words in split]
        if self.words.fresh:
            learnt = self._learn()
            for places in found:
                fresh = places < 0
                places[fresh] = learnt[-1 - places[fresh]]
        return [_gather(self.flat, self.first[places], self.count[places]) for places in found]

    def decode(self, ids: np.ndarray) -> str:
        if not hasattr(self, "automaton"):
            self._start()
        return _gather(self.piece_bytes, self.piece_first[ids], self.piece_sizes[ids]).tobytes().decode("utf-8", "replace")


def _gather(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs flat[first : first + count], end to end."""
    ends = np.cumsum(count)
    return flat[np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]


def build_lexicon(docs: DataFrame, text_col: str = "text", vocabulary_path: str | None = None, words: int = LEXICON_WORDS) -> Lexicon:
    """The most frequent words of all texts, at most ``words``, compiled on the driver. A grade of frequency goes in as a whole or not at all."""
    spark = docs.sparkSession
    vocabulary = Vocabulary(vocabulary_path or default_vocabulary())
    counts = cut_lineage(word_counts(docs, text_col).withColumn("grade", F.floor(F.log(F.col("n")) * 8).cast("int")))
    grades = counts.groupBy("grade").agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("grade").desc()).collect()  # some hundred
    held, least = 0, None
    for r in grades:
        held += r["words"]
        if held > words:
            break
        least = r["grade"]
    chosen = sorted(bytes(r["word"]) for r in counts.filter(F.col("grade") >= least).select("word").collect()) if least is not None else []
    coded = [vocabulary.merge(w) for w in chosen]
    name = _ship(spark, Transducer.compile(chosen).to_bytes())
    ids = np.fromiter((i for c in coded for i in c), np.uint32)
    return Lexicon(vocabulary, name, ids, np.fromiter(map(len, coded), np.int64, len(coded)))


def _ship(spark: SparkSession, content: bytes) -> str:
    """Put a file into the shared folder and have Spark copy it to every executor, late ones too."""
    ensure_checkpoint_dir(spark)
    sc, name = spark.sparkContext, f"lexicon-{uuid.uuid4().hex}.npy"
    place = sc._jvm.org.apache.hadoop.fs.Path(f"{sc.getCheckpointDir()}/{name}")
    out = place.getFileSystem(sc._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(content))
    out.close()
    sc.addFile(place.toString())
    return name


def encode(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", decoded: bool = False, digest: bool = False) -> DataFrame:
    """``docs`` with ``ids``: little-endian unsigned 32-bit integers end to end; with ``decoded`` also the text they decode to, with
    ``digest`` also its sha256 (``decoded_sha256``), for which the decoded text need not leave the worker.

    A worker holds the words and ids of one portion of texts at a time and hands it on before it takes the next.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = ["row", "ids"] + ["decoded"] * decoded + ["decoded_sha256"] * digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for batch in batches:
            at = 0
            for some in portions((t.as_py() or "" for t in batch.column(1)), PORTION):
                ids = lex.encode(some)
                columns = [batch.column(0).slice(at, len(some)), pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())]
                if decoded:
                    columns.append(pa.array([lex.decode(i) for i in ids], pa.string()))
                if digest:
                    columns.append(pa.array([hashlib.sha256(lex.decode(i).encode()).hexdigest() for i in ids], pa.string()))
                at += len(some)
                yield pa.RecordBatch.from_arrays(columns, names)

    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")
    packed = docs.select(rest, F.col(text_col).alias("text"))
    schema = T.StructType([packed.schema["row"], T.StructField("ids", T.BinaryType())] + [T.StructField(n, T.StringType()) for n in names[2:]])
    return packed.mapInArrow(lean(run), schema)


def decode(coded: DataFrame, lexicon: Lexicon, ids_col: str = "ids") -> DataFrame:
    """``coded`` with ``text``, decoded from its ids (null: empty)."""
    shared = coded.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.decode(np.frombuffer(i or b"", "<u4")) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    packed = coded.select(F.struct("*").alias("row"), F.col(ids_col).alias("ids"))
    return packed.mapInArrow(run, T.StructType([packed.schema["row"], T.StructField("text", T.StringType())]))


def encoded_digests(docs: DataFrame) -> DataFrame:
    coded = encode(docs.select("doc_id", "text"), build_lexicon(docs), digest=True)
    return coded.select(F.col("row.doc_id").alias("doc_id"), F.floor(F.length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")


@query("op6_bpe")
def op6(spark, sf_dir):
    return encoded_digests(table(spark, sf_dir, "documents"))
