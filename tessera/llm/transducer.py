"""Minimal acyclic transducers: sorted terms to lexicographic ordinals, with a walk over many tokens at once.

A transducer is built from terms in byte order, one after the other: what no later term can extend is
frozen, and a frozen state equal to an earlier one (same end mark, same edges) becomes that state, so the
automaton is minimal at every step. An edge carries the number of terms that sort before all terms
through it; along a path these outputs add up to the term's ordinal.

For walking, the edges become a dense table over the bytes that occur, and all tokens of a buffer take
their next byte together.
"""
from __future__ import annotations

import numpy as np

DEAD, ACCEPT = 0, 1  # states; others start at 2
HEADER = 3  # integers: states, edges, root

#: Bytes of terms: letters (A-Z become a-z) and everything beyond ASCII; others separate terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Transducer:
    """Edges (state, byte) -> (state, output) and final states."""

    def __init__(self, source: np.ndarray, byte: np.ndarray, target: np.ndarray, output: np.ndarray, final: np.ndarray, root: int):
        self.source, self.byte, self.target, self.output, self.final, self.root = source, byte, target, output, final, root

    @classmethod
    def build(cls, terms: list[bytes]) -> "Transducer":
        """From distinct, non-empty terms in byte order."""
        register: dict[tuple, int] = {}
        below = [0, 0]  # terms accepted from each frozen state
        finals, states = [0, 0], [(), ()]
        path = [[False, []]]  # of the last term: [final, edges] of states that may still change

        def freeze(node) -> int:
            key = (node[0], tuple(node[1]))
            state = register.get(key)
            if state is None:
                state = register[key] = len(states)
                states.append(key[1])
                finals.append(node[0])
                below.append(node[0] + sum(below[t] for _, t in key[1]))
            return state

        def cut(depth: int, last: bytes) -> None:
            while len(path) > depth + 1:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], freeze(node)))

        last = b""
        for term in terms:
            if not term > last:
                raise ValueError("terms must be distinct, not empty and in byte order")
            depth, least = 0, min(len(last), len(term))
            while depth < least and last[depth] == term[depth]:
                depth += 1
            cut(depth, last)
            path.extend([False, []] for _ in range(len(term) - depth))
            path[-1][0] = True
            last = term
        cut(0, last)
        root = freeze(path[0])
        source, byte, target, output = [], [], [], []
        for state, edges in enumerate(states):
            before = int(finals[state])
            for b, t in edges:
                source.append(state)
                byte.append(b)
                target.append(t)
                output.append(before)
                before += below[t]
        return cls(np.array(source, np.int32), np.array(byte, np.uint8), np.array(target, np.int32), np.array(output, np.int32),
                   np.array(finals, np.uint8), root)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.final), len(self.source), self.root], "<i4")
        return b"".join(x.tobytes() for x in (head, self.source, self.target, self.output, self.byte, self.final))

    @classmethod
    def from_bytes(cls, data: bytes) -> "Transducer":
        states, edges, root = np.frombuffer(data, "<i4", HEADER).tolist()
        at, parts = 4 * HEADER, []
        for kind, n in (("<i4", edges), ("<i4", edges), ("<i4", edges), ("u1", edges), ("u1", states)):
            parts.append(np.frombuffer(data, kind, n, at))
            at += parts[-1].nbytes
        source, target, output, byte, final = parts
        return cls(source, byte, target, output, final, root)

    def dense_bytes(self) -> int:
        """Size of the table that Walker makes."""
        return 8 * len(self.final) * (1 + len(np.unique(self.byte)))


class Walker:
    """A transducer as one table: state and byte class to output (high half) and next state (low half)."""

    def __init__(self, t: Transducer):
        used = np.unique(t.byte)
        self.classes = np.zeros(256, np.int64)  # class 0: the separator
        self.classes[used] = np.arange(1, len(used) + 1)
        self.unknown = np.ones(256, bool)
        self.unknown[used] = False
        self.unknown[32] = False
        self.width, self.root = len(used) + 1, t.root
        self.table = np.zeros(len(t.final) * self.width, np.int64)
        self.table[np.flatnonzero(t.final) * self.width] = ACCEPT
        self.table[t.source.astype(np.int64) * self.width + self.classes[t.byte]] = t.target.astype(np.int64) | t.output.astype(np.int64) << 32

    def ordinals(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, ordinals): which of the tokens starting at ``starts`` in the folded ``text`` are terms. ``text`` ends with a separator."""
        token, at = np.arange(len(starts)), starts
        state, total = np.full(len(starts), self.root * self.width), np.zeros(len(starts), np.int64)
        found, named = [], []
        while len(token):
            byte = text[at]
            edge = self.table[state + self.classes[byte]]
            edge[self.unknown[byte]] = DEAD
            state = edge & 0xFFFFFFFF
            total += edge >> 32
            ended = state == ACCEPT
            if ended.any():
                found.append(token[ended])
                named.append(total[ended])
            go = np.flatnonzero(state > ACCEPT)
            token, at, total, state = token[go], at[go] + 1, total[go], state[go] * self.width
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found), np.concatenate(named)


def folded(text: bytes) -> bytes:
    """``text`` with terms in lower case and a space for every byte that belongs to none."""
    return text.translate(FOLD)


def pieces(text: bytes, size: int):
    """A folded text in parts of about ``size`` bytes, cut at separators."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size) if at + size < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end
