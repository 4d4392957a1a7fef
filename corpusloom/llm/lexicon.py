"""A minimal acyclic transducer: words in, token ids out, with shared prefixes and suffixes.

The automaton is minimal (Daciuk's incremental construction over sorted words). Every state knows how many words end below
it, so that a walk numbers the words; the number points into one flat array of ids. All of it is a few flat arrays in one
file that the workers map into memory, and a whole array of words is walked at once, one byte a step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Words longer than this many bytes are never put into the lexicon; they are merged when met.
LONGEST = 24


class Lexicon:
    ARRAYS = ("keys", "targets", "skips", "final", "offsets", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update({k: arrays[k] for k in self.ARRAYS})

    # -- building, on the driver, from a bounded number of words ----------------------------------------------------

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Lexicon:
        states: list[dict[int, int]] = [{}]
        final: list[bool] = [False]
        register: dict[tuple, int] = {}
        path: list[int] = [0]  # states of the last word, root first
        last = b""

        def fold(down_to: int) -> None:
            while len(path) > down_to + 1:
                child = path.pop()
                sign = (final[child], *sorted(states[child].items()))
                known = register.setdefault(sign, child)
                states[path[-1]][last[len(path) - 1]] = known

        order = sorted(w for w in words if 0 < len(w) <= LONGEST)
        for word in order:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            fold(common)
            for byte in word[common:]:
                states.append({})
                final.append(False)
                states[path[-1]][byte] = len(states) - 1
                path.append(len(states) - 1)
            final[path[-1]] = True
            last = word
        fold(0)
        # Number the states that remain; count the words below each.
        number, stack, below = {0: 0}, [0], {}
        while stack:
            for t in states[stack.pop()].values():
                if t not in number:
                    number[t] = len(number)
                    stack.append(t)

        def count(root: int) -> None:
            todo = [(root, False)]
            while todo:
                s, ready = todo.pop()
                if s in below:
                    continue
                if ready:
                    below[s] = int(final[s]) + sum(below[t] for t in states[s].values())
                else:
                    todo.append((s, True))
                    todo += [(t, False) for t in states[s].values()]

        count(0)
        edges = []
        for s, n in number.items():
            skip = int(final[s])
            for byte, t in sorted(states[s].items()):
                edges.append((n << 8 | byte, number[t], skip))
                skip += below[t]
        edges.sort()
        keys, targets, skips = (np.array(c, np.uint32) for c in zip(*edges)) if edges else (np.zeros(0, np.uint32),) * 3
        ends = np.zeros(len(number), np.uint8)
        for s, n in number.items():
            ends[n] = final[s]
        ids = [words[w] for w in order]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.uint32)
        flat = np.array([i for x in ids for i in x], np.int32)
        return cls({"keys": keys, "targets": targets, "skips": skips, "final": ends, "offsets": offsets, "ids": flat})

    def to_bytes(self) -> bytes:
        parts = [np.ascontiguousarray(getattr(self, k)) for k in self.ARRAYS]
        parts = [p.astype(np.uint32) if p.dtype != np.int32 else p for p in parts]
        head = np.array([len(p) for p in parts], np.int64).tobytes()
        return head + b"".join(p.tobytes() for p in parts)

    @classmethod
    def view(cls, raw: np.ndarray) -> Lexicon:
        """Over the bytes of a file, mapped or read; nothing is copied."""
        sizes = raw[: 8 * len(cls.ARRAYS)].view(np.int64)
        at, arrays = 8 * len(cls.ARRAYS), {}
        for name, n in zip(cls.ARRAYS, sizes.tolist()):
            arrays[name] = raw[at : at + 4 * n].view(np.int32 if name == "ids" else np.uint32)
            at += 4 * n
        return cls(arrays)

    # -- looking up -------------------------------------------------------------------------------------------------

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each word of a binary or string array, or -1."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
        size = np.diff(offsets)
        live = np.flatnonzero((size > 0) & (size <= LONGEST))
        if not len(live):
            return out
        raw = np.frombuffer(data, np.uint8)
        grid = raw[np.minimum(offsets[live][:, None] + np.arange(LONGEST), len(raw) - 1)]
        size = size[live]
        state, total, at = np.zeros(len(live), np.uint32), np.zeros(len(live), np.int64), np.arange(len(live))
        for step in range(LONGEST):
            done = size[at] == step
            if done.any():
                d = at[done]
                ok = self.final[state[d]] > 0
                out[live[d[ok]]] = total[d[ok]]
                at = at[~done]
            if not len(at):
                return out
            key = (state[at] << np.uint32(8)) | grid[at, step]
            where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[where] == key
            at, where = at[hit], where[hit]
            state[at] = self.targets[where]
            total[at] += self.skips[where]
        d = at[size[at] == LONGEST]
        ok = self.final[state[d]] > 0
        out[live[d[ok]]] = total[d[ok]]
        return out
