"""A minimal acyclic transducer: a sorted word list compiled into a shared-suffix automaton whose arcs carry numbers.

The numbers along a word's path add up to the word's place in the list. Words are looked up many at a time: one numpy step per
byte position for all of them.
"""

from __future__ import annotations

import io

import numpy as np


END = 256  # stands behind a word's last byte


class Transducer:
    """``arcs`` has three rows: state * 257 + byte (or ``END``) in order, the state the arc leads to, the number on it. State 1 is the start."""

    def __init__(self, arcs: np.ndarray):
        self.arcs = arcs

    @classmethod
    def compile(cls, words: list[bytes]) -> Transducer:
        """From words in byte order without repeats. A state is stored once its outgoing arcs are complete, and equal states are
        stored once, so equal suffixes share their states."""
        known: dict[tuple, int] = {}
        arcs: list[dict[int, int]] = [{}, {}]
        ends: list[bool] = [False, False]
        path: list[tuple[dict[int, int], bool]] = [({}, False)]  # the open states along the last word

        def close(depth: int, word: bytes) -> None:
            while len(path) > depth + 1:
                out, end = path.pop()
                key = (end, *out.items())
                state = known.get(key)
                if state is None:
                    state = known[key] = len(arcs)
                    arcs.append(out)
                    ends.append(end)
                path[-1][0][word[len(path) - 1]] = state

        last = b""
        for word in words:
            same = 0
            while same < min(len(last), len(word)) and last[same] == word[same]:
                same += 1
            close(same, last)
            path.extend(({}, False) for _ in range(len(word) - same))
            path[-1] = (path[-1][0], True)
            last = word
        close(0, last)
        arcs[1], ends[1] = path[0]
        # words below a state; stored states only point to states stored before them
        below = [0] * len(arcs)
        order = [*range(2, len(arcs)), 1]
        for s in order:
            below[s] = ends[s] + sum(below[t] for t in arcs[s].values())
        rows = []
        for s in range(1, len(arcs)):
            ahead = int(ends[s])
            for b in sorted(arcs[s]):
                rows.append((s * 257 + b, arcs[s][b], ahead))
                ahead += below[arcs[s][b]]
            if ends[s]:
                rows.append((s * 257 + END, 0, 0))
        return cls(np.array(rows, np.int64).reshape(-1, 3).T.copy())

    def to_bytes(self) -> bytes:
        """A file's content that ``open`` maps into memory."""
        out = io.BytesIO()
        np.save(out, self.arcs)
        return out.getvalue()

    @classmethod
    def open(cls, path: str) -> Transducer:
        return cls(np.load(path, mmap_mode="r"))

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the list, -1 for words that are not in it."""
        out = np.full(len(words), -1, np.int64)
        if not words:
            return out
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(sizes) - sizes
        alive = np.arange(len(words))
        state, place = np.ones(len(words), np.int64), np.zeros(len(words), np.int64)
        keys, to, gain = self.arcs
        for at in range(int(sizes.max()) + 1):
            ended = sizes[alive] == at
            label = np.where(ended, END, text[np.minimum(first[alive] + at, len(text) - 1)].astype(np.int64) if len(text) else END)
            wanted = state[alive] * 257 + label
            arc = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            found = keys[arc] == wanted if len(keys) else np.zeros(len(alive), bool)
            out[alive[found & ended]] = place[alive[found & ended]]
            on = found & ~ended
            place[alive[on]] += gain[arc[on]]
            state[alive[on]] = to[arc[on]]
            alive = alive[on]
            if not len(alive):
                break
        return out
