"""Folding of texts to plain ASCII and similarity of texts, as expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import let

WORD = 62  # bits of a long that a row of the comparison uses: twice such a number and a carry still fit


@cache
def _folding() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition leaves of a character in ASCII: one character for one, and the longer ones."""
    single, longer = {}, {}
    for cp in range(0x80, 0x20000):
        if not 0xD800 <= cp < 0xE000:
            flat = unicodedata.normalize("NFKD", chr(cp)).encode("ascii", "ignore").decode()
            if flat:
                (single if len(flat) == 1 else longer)[chr(cp)] = flat
    return "".join(single), "".join(single.values()), longer


def ascii_norm(text: Column) -> Column:
    """Lower case, accents removed, other non-ASCII dropped, no punctuation, single blanks."""
    one, plain, longer = _folding()
    low = F.lower(text)
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in longer.items()])
    spelled = let(low, lambda t: F.when(t.rlike(f"[{''.join(longer)}]"), F.aggregate(pairs, t, lambda x, p: F.replace(x, p["k"], p["v"]))).otherwise(t))
    flat = F.regexp_replace(F.translate(spelled, one, plain), r"[^A-Za-z0-9_ \t\n\r\f\x0b\x1c-\x1f]", "")
    return F.btrim(F.regexp_replace(flat, r"[ \t\n\r\f\x0b\x1c-\x1f]+", " "))


def characters(text: Column) -> Column:
    """The code points of a text, in order."""
    n = F.length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence.

    Bit-parallel: a row has a bit per character of ``a``, ``WORD`` bits a word, and a character of ``b`` changes it by an addition with carry.
    """
    full = (1 << WORD) - 1
    longs = F.array().cast("array<bigint>")

    def compare(chars: Column, words: Column) -> Column:
        alphabet = F.array_distinct(chars)

        def bits(c: Column, w: Column) -> Column:
            hit = F.transform(F.slice(chars, w * WORD + 1, F.lit(WORD)), lambda x, i: F.when(x == c, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
            return F.aggregate(hit, F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))

        masks = F.map_from_arrays(alphabet, F.transform(alphabet, lambda c: F.transform(words, lambda w: bits(c, w))))

        def step(row: Column, mask: Column) -> Column:
            def add(state: Column, w: Column) -> Column:
                r = F.get(row, w)
                u = r.bitwiseAND(F.get(mask, w))
                total = r + u + state["carry"]
                return F.struct(F.array_append(state["row"], total.bitwiseAND(F.lit(full)).bitwiseOR(r - u)).alias("row"), F.shiftright(total, WORD).alias("carry"))

            return F.aggregate(words, F.struct(longs.alias("row"), F.lit(0).cast("bigint").alias("carry")), add)["row"]

        start = F.transform(words, lambda w: F.lit(full))
        known = lambda m: F.aggregate(characters(b), start, lambda row, c: F.when(F.map_contains_key(m, c), step(row, F.element_at(m, c))).otherwise(row))
        last = let(masks, known)
        return F.aggregate(last, F.lit(0), lambda s, r: s + WORD - F.bit_count(r))

    n = F.length(a)
    words = F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / WORD).cast("int"))
    return F.when((n == 0) | (F.length(b) == 0), F.lit(0)).otherwise(let(characters(a), lambda chars: let(words, lambda w: compare(chars, w))))


def similarity(a: Column, b: Column) -> Column:
    """100 * (1 - insertions and deletions / total length)."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * common_subsequence(a, b) / total)


def signature(text: Column) -> Column:
    """A set of 64 bits from the characters of a text, the second "e" apart from the first: a character that has no partner
    in the other text is missing from its set or hidden, never invented."""

    def mark(chars: Column, c: Column, i: Column) -> Column:
        times = F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c))
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.hash(c, times), F.lit(64)))

    return let(characters(text), lambda chars: F.aggregate(F.transform(chars, lambda c, i: mark(chars, c, i)), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x)))
