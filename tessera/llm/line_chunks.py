"""Repeated passages removed by content-defined line chunks.

Each line has a hash; a rolling hash over a line and the one before it says where
a chunk ends, so boundaries follow the content and come back in step one line
after an insertion. A line of ``long_words`` words or more is a chunk of its own.
Chunks of several lines, and long lines, that occur more than once in all
documents are removed but for the first occurrence (smallest doc_id, then
position). A chunk is removed only if the bytes of all chunks with its hash are
equal. DataFrame functions only.

``line_dedup`` is that pass alone, as its SQL states it. Its chunks' ends miss most
passages of a few short lines, so ``cleaned`` adds a pass over windows: the
shortest runs of two lines or more with ``long_words`` words that start or end at
each line. Any repeated run of lines with so many words is covered by windows that
repeat with it, so each of its lines goes, whatever stands around it, but for the
first occurrence (same order; lines of it that a later, overlapping occurrence
shares stay). Windows meet by hash and are removed only if their bytes are equal.

Defined results: a null text stays null and has no lines; a text without
removals stays as it is, byte for byte; a text of which all is removed is empty.
The row with a null doc_id comes last in order. Rows that repeat both doc_id and
text are one document: they keep the same chunks. Blank chunks are never removed.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.plan import materialize
from tessera.llm.common import equal_nulls, written

LONG_WORDS = 50
EVERY = 4
KEY = ["doc_id", "_v"]


def line_hash(line):
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def chunked(docs: DataFrame, long_words: int = LONG_WORDS, every: int = EVERY) -> DataFrame:
    """docs (doc_id, text) with _v (hash of the text), n_lines and _chunks: (eligible, text) in order."""
    base = docs.select("doc_id", "text")
    # A line with fewer characters cannot hold that many words.
    step = materialize(base, _lines=F.split(F.col("text"), "\n", -1))
    step = materialize(step, _hash=F.transform("_lines", line_hash),
                       _long=F.transform("_lines", lambda x: F.when(F.length(x) >= 2 * long_words - 1, F.size(F.split(x, " ")) >= long_words)
                                         .otherwise(F.lit(False))))
    n = F.size("_lines")
    # get() counts from 0 and gives null past either end; line i (from 1) is element i - 1.
    rolled = lambda i: (F.get("_hash", i - 1) * 31 + F.coalesce(F.get("_hash", i - 2), F.lit(0))) % 1000003
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | F.get("_long", i - 1) | F.get("_long", i) | (rolled(i) % every == 0))
    step = materialize(step, _ends=ends)
    chunks = F.transform("_ends", lambda e, j: F.struct(
        (((e - F.coalesce(F.get("_ends", j - 1), F.lit(0))) > 1) | F.get("_long", e - 1)).alias("eligible"),
        F.array_join(F.slice("_lines", F.coalesce(F.get("_ends", j - 1), F.lit(0)) + 1, e - F.coalesce(F.get("_ends", j - 1), F.lit(0))),
                     "\n").alias("chunk"),
        (e - F.coalesce(F.get("_ends", j - 1), F.lit(0))).alias("lines"), e.alias("last")))
    step = materialize(step, _chunks=F.when(F.col("text").isNotNull(), chunks))
    return step.select("doc_id", "text", F.xxhash64("text").alias("_v"), F.coalesce(n, F.lit(0)).cast("long").alias("n_lines"), "_chunks")


def occurrences(cut: DataFrame) -> DataFrame:
    """Eligible chunks: key, position, hash, length, bytes."""
    rows = cut.select(*KEY, F.posexplode("_chunks").alias("_at", "_c")).where(F.col("_c.eligible") & (F.trim("_c.chunk") != ""))
    return rows.select(*KEY, "_at", F.xxhash64("_c.chunk").alias("_h"), F.octet_length("_c.chunk").alias("_len"), F.col("_c.chunk").alias("_chunk"),
                       (F.col("_c.last") - F.col("_c.lines") + 1).alias("_s"), F.col("_c.last").alias("_e"))


def removals(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, _v, _gone, _runs): chunks to remove from each document that has any, by position and as (first, last) line."""
    places = occurrences(chunked(docs, **options))
    # Byte comparison: text is the grouping key itself, combined on the map side before it moves.
    contents = places.groupBy("_h", "_len", "_chunk").agg(F.count("*").alias("_times")).groupBy("_h", "_len").agg(
        F.count("*").alias("_contents"), F.sum("_times").alias("_times"))
    repeated = written(contents.where("_contents = 1 AND _times > 1").select("_h", "_len"), "line-repeated")
    again = written(places.select(*KEY, "_at", "_h", "_len", "_s", "_e").join(repeated, ["_h", "_len"]), "line-places")
    order = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_v", "_at")
    first = again.groupBy("_h", "_len").agg(F.min(order).alias("_first"))
    return (again.join(first, ["_h", "_len"]).where(order != F.col("_first"))
            .groupBy(*KEY).agg(F.collect_set("_at").alias("_gone"), F.collect_set(F.struct("_s", "_e")).alias("_runs")))


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, text without the removed chunks, n_lines (before), n_removed (lines), n_chunks_removed."""
    cut = chunked(docs, **options)
    gone = removals(docs, **options)
    joined = cut.join(gone, equal_nulls(cut, gone, KEY), "left").select(cut["*"], "_gone")
    kept = F.filter("_chunks", lambda c, i: ~F.array_contains("_gone", i))
    lost = F.filter("_chunks", lambda c, i: F.array_contains("_gone", i))
    some = F.col("_gone").isNotNull()
    return joined.select(
        "doc_id", F.when(some, F.array_join(F.transform(kept, lambda c: c["chunk"]), "\n")).otherwise(F.col("text")).alias("text"), "n_lines",
        F.when(some, F.aggregate(lost, F.lit(0).cast("long"), lambda a, c: a + c["lines"])).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(some, F.size(lost)).otherwise(F.lit(0)).cast("long").alias("n_chunks_removed"))


def windows(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """Shortest runs of 2 lines or more with ``long_words`` words, from and to each line that is not blank.

    key, _s and _e (first and last line, from 1), _h.
    """
    words_in = lambda x: F.size(F.filter(F.split(x, " "), lambda w: w != ""))
    step = materialize(docs.select("doc_id", F.xxhash64("text").alias("_v"), "text").where(F.col("text").contains("\n")),
                       _lines=F.split(F.col("text"), "\n", -1))
    step = materialize(step, _all=F.transform("_lines", words_in), _hash=F.transform("_lines", lambda x: F.xxhash64(x)))
    step = materialize(step, _at=F.filter(F.sequence(F.lit(1), F.size("_lines")), lambda i: F.get("_all", i - 1) > 0),
                       _words=F.filter("_all", lambda w: w > 0))
    # (words, lines) of the shortest run; a run has long_words lines at most, blank ones apart.
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"))
    shortest = lambda part: F.aggregate(part, start, lambda a, w: F.when(a["words"] >= long_words, a).otherwise(
        F.struct((a["words"] + w).alias("words"), (a["lines"] + 1).alias("lines"))))
    pair = lambda run, first, last: F.when((run["words"] >= long_words) & (run["lines"] > 1), first * F.lit(1 << 31) + last)
    step = materialize(step, _from=F.transform("_at", lambda i, a: shortest(F.slice("_words", a + 1, long_words))),
                       _to=F.transform("_at", lambda i, a: shortest(F.reverse(F.slice(
                           "_words", F.greatest(a + 2 - long_words, F.lit(1)), F.least(a + 1, F.lit(long_words)))))))
    ahead = F.transform("_from", lambda r, a: pair(r, F.get("_at", a), F.get("_at", a + r["lines"] - 1)))
    back = F.transform("_to", lambda r, a: pair(r, F.get("_at", a + 1 - r["lines"]), F.get("_at", a)))
    step = step.select(*KEY, "_hash", F.array_union(ahead, back).alias("_pairs"))
    first, last = lambda p: F.shiftright(p, 31).cast("int"), lambda p: (p % (1 << 31)).cast("int")
    found = F.transform(F.filter("_pairs", lambda p: p.isNotNull()), lambda p: F.struct(
        first(p).alias("_s"), last(p).alias("_e"), F.xxhash64(F.slice("_hash", first(p), last(p) - first(p) + 1)).alias("_h")))
    return step.select(*KEY, F.inline(found))


def passages(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, _v, _runs): runs of lines (first, last) of each document that stand earlier too."""
    places = windows(docs, long_words)
    repeated = written(places.groupBy("_h").agg(F.count("*").alias("_times")).where("_times > 1").select("_h"), "line-repeats")
    again = written(places.join(repeated, "_h"), "line-windows")
    # Byte comparison of the repeated windows, cut again from their documents.
    own = docs.select("doc_id", F.xxhash64("text").alias("_v"), "text")
    listed = again.groupBy(*KEY).agg(F.collect_set(F.struct("_s", "_e", "_h")).alias("_list"))
    texts = materialize(own.join(listed, equal_nulls(own, listed, KEY)).select("text", "_list"), _lines=F.split(F.col("text"), "\n", -1))
    texts = texts.select("_lines", F.explode("_list").alias("_w")).select(
        "_w._h", F.array_join(F.slice("_lines", F.col("_w._s"), F.col("_w._e") - F.col("_w._s") + 1), "\n").alias("_text"))
    equal = texts.groupBy("_h", "_text").agg(F.lit(1).alias("_one")).groupBy("_h").agg(F.count("*").alias("_contents")).where("_contents = 1")
    order = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_v", "_s")
    first = again.groupBy("_h").agg(F.min(order).alias("_first")).join(equal.select("_h"), "_h", "left_semi")
    same = F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("_v") == F.col("_first._v"))
    after = F.when(same, F.greatest(F.col("_s"), F.col("_first._s") + F.col("_e") - F.col("_s") + 1)).otherwise(F.col("_s"))
    return (again.join(first, "_h").where(order != F.col("_first"))
            .select(*KEY, after.alias("_s"), "_e").where("_s <= _e")
            .groupBy(*KEY).agg(F.collect_set(F.struct("_s", "_e")).alias("_runs")))


def cleaned(docs: DataFrame, long_words: int = LONG_WORDS, **options) -> DataFrame:
    """``docs`` without repeated chunks and passages, all columns kept; documents of which nothing is left go."""
    own = docs.withColumns({"_v": F.xxhash64("text")})
    both = removals(docs, long_words=long_words, **options).select(*KEY, "_runs").unionByName(passages(docs, long_words))
    runs = both.groupBy(F.col("doc_id").alias("_id"), F.col("_v").alias("_w")).agg(F.flatten(F.collect_list("_runs")).alias("_runs"))
    joined = own.join(runs, own["doc_id"].eqNullSafe(runs["_id"]) & own["_v"].eqNullSafe(runs["_w"]), "left")
    step = materialize(joined, _lines=F.when(F.col("_runs").isNotNull(), F.split(F.col("text"), "\n", -1)))
    gone = F.flatten(F.transform("_runs", lambda r: F.sequence(r["_s"], r["_e"])))
    kept = F.array_except(F.sequence(F.lit(1), F.size("_lines")), gone)
    step = materialize(step, _new=F.when(F.col("_runs").isNotNull(), F.array_join(F.transform(kept, lambda i: F.get("_lines", i - 1)), "\n")))
    return (step.where(F.col("_new").isNull() | (F.trim("_new") != ""))
            .withColumn("text", F.coalesce("_new", "text")).select(docs.columns))
