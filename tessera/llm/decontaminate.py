"""Benchmark decontamination by pigeonhole edit matching.

A test item that occurs in a text with at most k edits, cut into k + 1 pieces, has
at least one piece that occurs unchanged. One automaton finds all exact piece
hits; around each hit, Myers' bit-parallel algorithm looks for ever larger parts
of the item, at last for all of it within its error budget (a tenth of its
characters). Windows of one item that touch are
checked as one. Texts and items are compared in lower case (A-Z) with white space
runs as one space.

The items are read in shards of at most ``SHARD_CHARS`` characters (one item at
least); each shard is one automaton sent to the tasks, so what is sent has a
bound and every item is searched in every whole text.

Defined results: a null or empty text matches nothing; null, empty and blank
items match nothing; rows with equal item_id are one item with several texts; a
null item_id is not reported. Each input row gives one row, repeated rows too.
"""
from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_texts

BUDGET = 0.1
SHARD_CHARS = 4_000_000


def plain(text: bytes) -> str:
    return b" ".join(text.lower().split()).decode("utf-8", "replace")


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """One string for Myers' search: the least edit distance of it to any part of a window."""

    def __init__(self, item: str):
        self.item = item
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distance(self, window: str, enough: int = 0) -> int:
        """The least distance; the search ends where it is ``enough`` or less."""
        m, get = len(self.item), self.masks.get
        full, top = (1 << m) - 1, 1 << m - 1
        plus, minus, score = full, 0, m
        best = m
        for c in window:
            eq = get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | (full & ~(xh | plus))
            mh = plus & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < best:
                    best = score
                    if best <= enough:
                        break
            # Without a carry into bit 0 a match may begin anywhere in the window.
            ph = ph << 1 & full
            mh = mh << 1 & full
            plus = mh | (full & ~(xv | ph))
            minus = ph & xv
        return best


class Tree:
    """The pieces of an item joined two by two up to the item.

    If a node of c pieces occurs with at most c - 1 edits, one of its two parts does so too with its own count. So a piece hit
    counts only if each node above it is found around the hit within its budget; most chance hits end at the first node.
    """

    def __init__(self, item: str, budget: float):
        self.k = int(len(item) * budget)
        self.root = Pattern(item)
        self.leaves: list[tuple[str, int, list]] = []
        self.grow(pieces(item, self.k), len(item), [])

    def grow(self, parts: list[tuple[int, str]], end: int, above: list) -> None:
        if len(parts) == 1:
            self.leaves.append((parts[0][1], parts[0][0], above))
            return
        start = parts[0][0]
        here = above
        if above or end - start < len(self.root.item):  # the item itself is checked last, with joined windows
            here = [(Pattern(self.root.item[start:end]), start, end, len(parts) - 1), *above]
        half = len(parts) // 2
        self.grow(parts[:half], parts[half][0], here)
        self.grow(parts[half:], end, here)


def confirmed(text: str, at: int, offset: int, above: list) -> bool:
    """Whether every node above a piece hit is found around it."""
    for pattern, start, end, edits in above:
        window = text[max(0, at - (offset - start) - edits): at + (end - offset) + edits]
        if pattern.distance(window, edits) > edits:
            return False
    return True


def build(items: list[tuple[int, str]], budget: float):
    """Trees and the automaton of their pieces."""
    trees = [(item_id, Tree(text, budget)) for item_id, text in items]
    automaton, places = ahocorasick.Automaton(), {}
    for p, (_, tree) in enumerate(trees):
        for piece, offset, above in tree.leaves:
            places.setdefault(piece, []).append((p, offset, above))
    for piece, found in places.items():
        automaton.add_word(piece, (len(piece), found))
    automaton.make_automaton()
    return trees, automaton


def matches(text: str, trees, automaton) -> dict[int, int]:
    """item_id to its least distance, for the items within budget."""
    hits: dict[int, set[int]] = {}
    for end, (length, found) in automaton.iter(text):
        at = end - length + 1
        for p, offset, above in found:
            if at - offset not in hits.get(p, ()) and confirmed(text, at, offset, above):
                hits.setdefault(p, set()).add(at - offset)
    out: dict[int, int] = {}
    for p, starts in hits.items():
        item_id, tree = trees[p]
        m, k = len(tree.root.item), tree.k
        best, at = k + 1, None
        for start in sorted(starts) + [None]:
            if at is not None and (start is None or start - k > at[1]):
                best = min(best, tree.root.distance(text[at[0]: at[1]]))
                at = None
                if best == 0:
                    break
            if start is not None:
                at = (at[0] if at else max(0, start - k), start + m + k)
        if best <= k:
            out[item_id] = min(best, out.get(item_id, best))
    return out


def shards(benchmark: DataFrame):
    """Items in shards of a bounded number of characters, in order of item_id."""
    part, size = [], 0
    rows = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct().orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        item = plain(row["text"].encode())
        if not item:
            continue
        if part and size + len(item) > SHARD_CHARS:
            yield part
            part, size = [], 0
        part.append((row["item_id"], item))
        size += len(item)
    yield part


def search(rows: DataFrame, items: list[tuple[int, str]], budget: float) -> DataFrame:
    """``rows`` with ``_found``: the matching items of this shard as (item, distance)."""
    def make():
        trees, automaton = build(items, budget)

        def work(texts):
            found = [sorted(matches(plain(t), trees, automaton).items()) if items else [] for t in texts]
            return [pa.array([[{"item": i, "distance": d} for i, d in f] for f in found],
                             pa.list_(pa.struct([("item", pa.int64()), ("distance", pa.int32())])))]

        return work

    return map_texts(rows, rows.columns, "_found array<struct<item: bigint, distance: int>>", make)


def searched(docs: DataFrame, benchmark: DataFrame, budget: float) -> DataFrame:
    """``docs`` with ``_all``: every matching (item, distance), in order of item."""
    rows = docs
    for i, items in enumerate(shards(benchmark)):
        rows = search(rows, items, budget)
        rows = rows.withColumn("_all", F.col("_found") if i == 0 else F.concat("_all", "_found")).drop("_found")
    # An item whose texts fall into two shards is listed once, with its least distance.
    least = F.transform(F.array_distinct(F.transform("_all", lambda m: m["item"])), lambda i: F.struct(
        i.alias("item"), F.array_min(F.transform(F.filter("_all", lambda m: m["item"] == i), lambda m: m["distance"])).alias("distance")))
    return rows.withColumn("_all", least)


def edit_matches(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Per row: doc_id, contaminated, n_items, item_ids (sorted), distances (of those items)."""
    rows = searched(docs.select("doc_id", "text"), benchmark, budget)
    return rows.select("doc_id", (F.size("_all") > 0).alias("contaminated"), F.size("_all").cast("long").alias("n_items"),
                       F.col("_all.item").alias("item_ids"), F.col("_all.distance").alias("distances"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs`` without a match, all columns kept."""
    rows = docs.withColumnsRenamed({c: f"_in_{c}" for c in docs.columns if c not in ("doc_id", "text")})
    clean = searched(rows, benchmark, budget).where("size(_all) = 0")
    return clean.select(*[F.col(new).alias(old) for new, old in zip(rows.columns, docs.columns)])
