"""Repair of the structure of conversations: roles that must read ``(s?(ua)+)?``, at the least cost, in one streaming pass.

The rows are dealt by conversation and sorted inside each partition by conversation and falling turn (a secondary sort: one shuffle).
``mapInPandas`` then meets every conversation from its end. What it carries from row to row, across Arrow batches, is the cost to go
of four states (nothing written, after system, after user, after assistant). Every row adds one byte of back pointers (two bits a
state) and one byte of row facts; both, and the texts that may stay, move to an unlinked temporary file of the task once they pass
``SPILL`` bytes, so a conversation of any length takes bounded memory. At the conversation's first turn the pointers are read
backwards, which is forwards in turns, and give the edits.

Why from the end: edits of one step have different initials, so of equally cheap ways the one with the ASCII-least first letter is
the ASCII-least as a whole. From the front that would not hold, since one audit may be the prefix of another.

Edits and costs: Keep 0, Rerole to user or assistant 3, Delete 4 (a must for blank and repeated rows), Insert an empty turn of user or
assistant 3; a truncated row that stays adds 3.

Defined results: a null role or text is one space; null turns come first and are no part of the gaps; rows with equal turn go by role and text;
a role counts by its first letter, one that is not s, u or a cannot stay as it is; a null conversation id is a conversation of its
own; repeated rows are duplicates of each other; a conversation without rows left has zeros, an empty audit and the hash of the empty text;
an empty table gives an empty result; other columns may have any name, they are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import query, table

SPILL = 8 << 20  # bytes of texts, and of pointers, that a task holds of one conversation before they go to disk
BLANKS = " \t\n\x0b\f\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
START, SYSTEM, USER, ASSISTANT = range(4)
EDITS = "DIKR"  # in ASCII order
AFTER = (USER, USER, ASSISTANT, USER)  # the state after the one turn that may be inserted or reroled to in a state
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NEVER = 1 << 60


def _after_keep(state: int, initial: int) -> int | None:
    if initial == SYSTEM:
        return SYSTEM if state == START else None
    return initial if initial and initial == AFTER[state] else None


def _close(cost: list[int], pointer: list[int]) -> None:
    """Let every state insert a turn first where that is cheaper, or as cheap with a lesser letter. Two in a row are all that can help."""
    for states in ((USER, ASSISTANT), (START, SYSTEM)):
        offers = [(s, 3 + cost[AFTER[s]]) for s in states]
        for s, offer in offers:
            if offer < cost[s] or offer == cost[s] and pointer[s] > 1:
                cost[s], pointer[s] = offer, 1


def step(cost: tuple[int, ...], initial: int, fault: int) -> tuple[tuple[int, ...], int]:
    """The costs to go before a row, from those after it, and its four pointers in one byte."""
    now, pointer = [4 + c for c in cost], [0] * 4
    if fault not in (BLANK, DUPLICATE):
        more = 3 if fault == TRUNCATED else 0
        for s in range(4):
            kept = _after_keep(s, initial)
            for edit, c in ((2, more + cost[kept] if kept is not None else NEVER), (3, more + 3 + cost[AFTER[s]])):
                if c < now[s]:
                    now[s], pointer[s] = c, edit
    _close(now, pointer)
    return tuple(now), sum(p << 2 * s for s, p in enumerate(pointer))


END = (0, 6, 3, 0)  # after the last row: nothing to do, or the turns that complete a pair


class Backwards:
    """Records written one after the other and read from the last to the first; beyond ``SPILL`` bytes they lie in a file."""

    def __init__(self, limit: int):
        self.limit, self.held, self.size, self.file = limit, [], 0, None

    def add(self, record: bytes) -> None:
        self.held.append(record)
        self.size += len(record)
        if self.size > self.limit:
            self.file = self.file or tempfile.TemporaryFile()  # without a name: gone with the task
            for r in self.held:
                self.file.write(r + struct.pack("<Q", len(r)))
            self.held, self.size = [], 0

    def __iter__(self) -> Iterator[bytes]:
        while self.held:
            yield self.held.pop()
        if self.file:
            end = self.file.tell()
            while end:
                self.file.seek(end - 8)
                size = struct.unpack("<Q", self.file.read(8))[0]
                end -= 8 + size
                self.file.seek(end)
                yield self.file.read(size)
            self.file.close()


class Conversation:
    """One conversation, met from its last row to its first."""

    def __init__(self, conv: str | None, limit: int):
        self.conv = conv
        self.low = self.high = self.turn = None
        self.turns = self.illegal = self.total = 0
        self.faults = [0] * 4
        self.next = None
        self.cost, self.base = END, 0
        self.facts, self.texts = Backwards(limit), Backwards(limit)
        self.block = bytearray()

    def add(self, turn: int | None, role: str, text: str, fault: int, known: dict) -> None:
        if turn is not None:
            self.high = turn if self.high is None else self.high
            self.turns += turn != self.turn
            self.low = self.turn = turn
        initial = INITIAL.get(role[:1], 0)
        self.illegal += self.next is not None and (initial, self.next) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
        self.next = initial
        self.faults[fault] += 1
        at = self.cost, initial, fault
        if at not in known:  # costs less their least: a handful of cases
            now, pointers = step(*at)
            known[at] = tuple(c - min(now) for c in now), min(now), pointers
        self.cost, more, pointers = known[at]
        self.base += more
        stays = fault not in (BLANK, DUPLICATE)
        self.block += bytes((pointers, initial | stays << 2))
        if len(self.block) >= 1 << 16:
            self.facts.add(bytes(self.block))
            self.block = bytearray()
        if stays:
            name = role.encode("utf-8", "replace")
            self.texts.add(struct.pack("<I", len(name)) + name + text.encode("utf-8", "replace"))

    def edits(self) -> Iterator[tuple[str, str, str]]:
        """Initial of the edit, and role and text that stand afterwards (empty for a deleted row), from the first turn on."""
        self.facts.add(bytes(self.block))
        texts = iter(self.texts)
        state = START
        for block in self.facts:
            for i in range(len(block) - 2, -2, -2):
                pointers, fact = block[i], block[i + 1]
                while (edit := pointers >> 2 * state & 3) == 1:
                    state = AFTER[state]
                    yield "I", NAMES[state], ""
                if fact & 4:
                    record = next(texts)
                    size = 4 + struct.unpack("<I", record[:4])[0]
                if edit == 0:
                    yield "D", "", ""
                else:
                    state = _after_keep(state, fact & 3) if edit == 2 else AFTER[state]
                    yield EDITS[edit], record[4:size].decode() if edit == 2 else NAMES[state], record[size:].decode()
        while state in (SYSTEM, USER):
            state = AFTER[state]
            yield "I", NAMES[state], ""

    def report(self) -> tuple:
        audit, digest, first = bytearray(), hashlib.sha256(), True
        for edit, role, text in self.edits():
            audit += edit.encode()
            if edit != "D":
                digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.faults[1:], self.illegal, self.base + self.cost[START], audit.decode(), digest.hexdigest()


def conversations(frames: Iterator[pd.DataFrame], limit: int) -> Iterator[Conversation]:
    """The conversations of a sorted partition, one at a time; ``frames`` hold conv, left, timed, turn, role, text, fault."""
    now, known = None, {}
    for frame in frames:
        columns = (frame[c].tolist() for c in ("conv", "left", "timed", "turn", "role", "text", "fault"))
        for conv, left, timed, turn, role, text, fault in zip(*columns):
            if now is None or conv != now.conv:
                if now is not None:
                    yield now
                now = Conversation(conv, limit)
            if left:
                now.add(turn if timed else None, role, text, fault, known)
    if now is not None:
        yield now


def sorted_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", left: Column | None = None) -> DataFrame:
    """``conv, left, timed, turn, role, text, fault``, dealt by conversation and sorted from its end. ``left``: rows that count (all)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    picked = rows.select(F.col(conv_col).cast("string").alias("conv"), (F.lit(True) if left is None else left).alias("left"), F.col(turn_col).isNotNull().alias("timed"),
                         F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    told = F.rtrim(F.col("text"), F.lit(BLANKS))
    again = F.row_number().over(Window.partitionBy("conv", "left", "role", "text").orderBy("timed", "turn")) > 1
    fault = F.when(told == "", BLANK).when(again, DUPLICATE).when(~F.right(told, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    ordered = picked.repartition("conv").withColumn("fault", fault)
    return ordered.sortWithinPartitions("conv", F.desc("timed"), F.desc("turn"), F.desc("role"), F.desc("text"), F.desc(F.col("fault") == DUPLICATE))


def reports(ordered: DataFrame, limit: int = SPILL) -> DataFrame:
    """Per conversation of ``sorted_rows``: ``conv`` (as text), ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for c in conversations(frames, limit):
            held.append(c.report())
            size += 200 + len(held[-1][7])
            if size > 1 << 20:
                yield pd.DataFrame(held, columns=names)
                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=names)

    return ordered.mapInPandas(run, "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired_turns(ordered: DataFrame, limit: int = SPILL) -> DataFrame:
    """The repaired conversations of ``sorted_rows``: ``conv`` (as text), ``place`` (long, from 0), ``edit, role, text``."""
    names = ["conv", "place", "edit", "role", "text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for c in conversations(frames, limit):
            kept = (e for e in c.edits() if e[0] != "D")
            for place, (edit, role, text) in enumerate(kept):
                held.append((c.conv, place, edit, role, text))
                size += 100 + len(text)
                if size > 1 << 20:
                    yield pd.DataFrame(held, columns=names)
                    held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=names)

    return ordered.mapInPandas(run, "conv string, place long, edit string, role string, text string")


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, left`` with the faults of the contract, told by crc32 of ``conv_id:turn``; a dropped row has ``left`` false."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(space("role"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", "role", "text", kind.alias("kind")).select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("left"), twice.alias("copy")).drop("copy")


_CRC = """list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(k) + 1), lambda i: ascii(substr(k, i, 1))::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, z: case when x % 2 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))"""
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _least(*offers: str) -> str:
    return f"least({', '.join(offers)})"


def _plus(cost: int | str, edit: str, way: str) -> str:
    """A way is its cost in nine digits and its audit: the least string is the cheapest way with the ASCII-least audit."""
    return f"lpad((left({way}, 9)::bigint + {cost})::varchar, 9, '0') || '{edit}' || substr({way}, 10)"


def _oracle() -> str:
    def own(s: str) -> str:
        after = {"s0": "s2", "s1": "s2", "s2": "s3", "s3": "s2"}[s]
        letter = "a" if s == "s2" else "u"
        keep = [f"case when ini = '{letter}' and fault not in (1, 2) then {_plus('pen', 'K', after)} end"]
        if s == "s0":
            keep.append(f"case when ini = 's' and fault not in (1, 2) then {_plus('pen', 'K', 's1')} end")
        return _least(_plus(4, "D", s), *keep, f"case when fault not in (1, 2) then {_plus('pen + 3', 'R', after)} end")

    return f"""with recursive d as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
    xor({_CRC}, 4294967295) % 20 kind from (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') k from conversations)),
  e as (select conv_id, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
    from d, (values (0), (1)) t(copy) where kind <> 0 and (copy = 0 or kind = 3)),
  f as (select *, left(role, 1) ini, rtrim(text, {_BLANK}) told,
    row_number() over (partition by conv_id, role, text order by turn nulls first) again,
    lag(left(role, 1)) over (partition by conv_id order by turn nulls first, role, text) before from e),
  g as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, again) pos, case when told = '' then 1 when again > 1 then 2 when right(told, 1) not in ('.', '!', '?') then 3 else 0 end fault from f),
  h as (select *, case when fault = 3 then 3 else 0 end pen from g),
  n as (select conv_id, count(*) size, case when count(turn) = 0 then 0 else max(turn) - min(turn) + 1 - count(distinct turn) end gaps,
    count(*) filter (fault = 1) blank, count(*) filter (fault = 2) duplicate, count(*) filter (fault = 3) truncated,
    count(*) filter (before is not null and before || ini not in ('su', 'ua', 'au')) illegal, list(struct_pack(role := role, text := text) order by pos) turns from h group by conv_id),
  w as (select conv_id, size pos, '000000000' s0, '000000006II' s1, '000000003I' s2, '000000000' s3 from n
    union all select conv_id, pos - 1, {_least('b0', _plus(3, 'I', 'c2'))}, {_least('b1', _plus(3, 'I', 'c2'))}, c2, c3 from (
      select *, {_least('b2', _plus(3, 'I', 'b3'))} c2, {_least('b3', _plus(3, 'I', 'b2'))} c3 from (
        select w.conv_id, w.pos, {own('s0')} b0, {own('s1')} b1, {own('s2')} b2, {own('s3')} b3 from w join h on w.conv_id is not distinct from h.conv_id and w.pos = h.pos))),
  a as (select n.*, left(s0, 9)::bigint as cost, substr(s0, 10) audit from n join w on n.conv_id is not distinct from w.conv_id and w.pos = 0),
  p as (select *, list_transform(range(1, length(audit) + 1), lambda i: struct_pack(edit := audit[i],
      turn := turns[length(replace(left(audit, i), 'I', ''))],
      place := length(replace(left(audit, i), 'D', '')))) steps from a),
  q as (select *, list_filter(steps, lambda s: s.edit <> 'D') kept from p),
  r as (select *, case when kept[1].edit = 'K' and left(kept[1].turn.role, 1) = 's' then 1 else 0 end sys from q),
  t as (select conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256(coalesce(array_to_string(list_transform(kept, lambda s:
    case when s.edit = 'K' then s.turn.role when (s.place - sys) % 2 = 1 then 'user' else 'assistant' end || ':' || case when s.edit = 'I' then '' else s.turn.text end), chr(10)), '')) repaired_sha256 from r)
select o.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated,
  coalesce(illegal, 0)::bigint illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') audit, coalesce(repaired_sha256, sha256('')) repaired_sha256
from (select distinct conv_id from conversations) o left join t on o.conv_id is not distinct from t.conv_id"""


@query("op13_conversation_repair", _oracle())
def op13(spark, sf_dir):
    rows = damaged(table(spark, sf_dir, "conversations"))
    return reports(sorted_rows(rows, left=F.col("left"))).select(F.col("conv").cast(dict(rows.dtypes)["conv_id"]).alias("conv_id"), "gaps", "blank", "duplicate", "truncated",
                                                                "illegal", "cost", "audit", "repaired_sha256")
