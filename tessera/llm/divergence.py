"""Source divergence audit: how far the words of the sources of a language lie apart.

Terms are runs of letters (A-Z in lower case) and of everything beyond ASCII. Each language keeps
the terms that at least LEAST of its documents hold. They go into minimal acyclic transducers, built from the
terms in byte order, whose outputs are the terms' ordinals. The texts are then streamed through the transducers,
all tokens of a buffer byte by byte at once, which counts (language, source, ordinal); from there on only
ordinals are handled, and they break ties, being in the order of the terms' UTF-8 bytes.

A language with many terms has several transducers (shards), cut at terms taken from a hash sample, so that one
holds at most about SHARD terms. Transducers go to the tasks in batches of TABLES bytes of tables at most; each batch is one
pass over the texts. Distances between sources are summed in tiles of TILE sources and SLICE ordinals.

Defined results: a null text, lang or source counts as empty text. Every (lang, source) that occurs is a group, without
terms too; with no kept term its distances are 0. Rows are documents, repeated rows and ids too. An empty table
gives no rows. Texts may be of any length: they are worked through in pieces.
"""
from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import utf8, written
from tessera.llm.transducer import Transducer, Walker, folded, pieces

LEAST = 30  # documents of a language that hold a kept term
TOP = 50  # ranks of the part ``term``
SMOOTH = 5
UNIT = 1_000_000_000
SHARD = 1 << 17  # terms of a transducer, about
DRAWN = 64  # sampled terms for each shard
TABLES = 96 << 20  # bytes of walking tables held by a task
PIECE = 1 << 20  # bytes of text walked at once
HELD = 300_000  # entries a task holds before it gives them on
TILE = 256  # sources
SLICE = 4096  # ordinals


def groups_of(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def document_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, n): documents of the language that hold the term."""
    def rows(held: dict[str, Counter]):
        for lang, counts in held.items():
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(counts.keys(), pa.binary()),
                                                  pa.array(counts.values(), pa.int64())], ["lang", "term", "n"])

    def run(batches):
        held: dict[str, Counter] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                seen: set[bytes] = set()
                for piece in pieces(folded(text), PIECE):
                    seen.update(piece.split())
                own = held.setdefault(lang, Counter())
                size -= len(own)
                own.update(seen)
                size += len(own)
                if size > HELD:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    found = docs.select("lang", "text").mapInArrow(run, "lang string, term binary, n bigint")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def bounds_of(kept: DataFrame) -> dict[str, list[bytes]]:
    """Per language with more than SHARD terms, the terms at which its shards begin, but for the first."""
    large = {r["lang"]: r["n"] for r in kept.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") > SHARD).collect()}
    out = {}
    for lang, n in large.items():
        shards = -(-2 * n // SHARD)
        drawn = kept.where(F.col("lang") == lang).orderBy(F.xxhash64("term")).limit(DRAWN * shards).select("term").collect()
        terms = sorted(bytes(r["term"]) for r in drawn)
        out[lang] = sorted(set(terms[DRAWN // 2::DRAWN]))
    return out


def vocabulary(kept: DataFrame) -> DataFrame:
    """The terms (lang, shard, pos, term) and, at pos -1, the transducer of each shard with its terms and its table's size."""
    bounds = bounds_of(kept)

    def sharded(batches):
        for batch in batches:
            shard = [bisect_right(bounds.get(k, ()), t) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shard, pa.int32()), batch.column(1)], ["lang", "shard", "term"])

    def build(key, group):
        terms = sorted(group.column("term").to_pylist())
        made, n = Transducer.build(terms), len(terms)
        columns = {"lang": [key[0].as_py()] * (n + 1), "shard": [key[1].as_py()] * (n + 1), "pos": list(range(-1, n)), "term": [None, *terms],
                   "n": [n, *[None] * n], "size": [made.dense_bytes(), *[None] * n], "transducer": [made.to_bytes(), *[None] * n]}
        types = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns.values(), types)], list(columns))

    rows = kept.select("lang", "term").mapInArrow(sharded, "lang string, shard int, term binary")
    return rows.groupBy("lang", "shard").applyInArrow(
        build, "lang string, shard int, pos bigint, term binary, n bigint, size bigint, transducer binary")


def batches_of(shards: list) -> list[list]:
    """Shards in order, cut into batches of TABLES bytes at most (one shard at least)."""
    out: list[list] = []
    size = 0
    for s in shards:
        if not out or size + s["size"] > TABLES:
            out.append([])
            size = 0
        out[-1].append(s)
        size += s["size"]
    return out


def recounted(docs: DataFrame, tables: list[tuple[str, int, bytes]]) -> DataFrame:
    """(lang, source, ordinal, n): occurrences of the terms of some transducers (lang, first ordinal, transducer)."""
    def counted(walkers, source: np.ndarray, texts: list[bytes]):
        """Keys source * 2^40 + ordinal of every occurrence in folded texts of one language."""
        buffer = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
        gap = buffer == 32
        starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        ends = np.cumsum([len(t) + 1 for t in texts])
        owner = source[np.searchsorted(ends, starts, side="left")]
        for first, walker in walkers:
            token, ordinal = walker.ordinals(buffer, starts)
            yield owner[token] << 40 | (ordinal + first)

    def run(batches):
        walkers: dict[str, list] = {}
        for lang, first, data in tables:
            walkers.setdefault(lang, []).append((first, Walker(Transducer.from_bytes(data))))
        names: list[tuple[str, str]] = []
        codes: dict[tuple[str, str], int] = {}
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        fresh: list[np.ndarray] = []

        def merged():
            every = np.concatenate([keys, *fresh])
            weight = np.concatenate([n, np.ones(len(every) - len(n), np.int64)])
            order = np.argsort(every, kind="stable")
            every, weight = every[order], weight[order]
            begin = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
            return every[begin], np.add.reduceat(weight, begin) if len(begin) else weight

        def rows():
            group = pa.array(keys >> 40)
            lang, source = (pa.array([x[i] for x in names], pa.string()).take(group) for i in (0, 1))
            return pa.RecordBatch.from_arrays([lang, source, pa.array(keys & ((1 << 40) - 1)), pa.array(n)], ["lang", "source", "ordinal", "n"])

        for batch in batches:
            waiting: dict[str, list] = {}

            def walk(lang):
                source, texts, _ = waiting.pop(lang)
                fresh.extend(counted(walkers[lang], np.array(source), texts))

            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                if lang not in walkers:
                    continue
                code = codes.setdefault((lang, source), len(names))
                if code == len(names):
                    names.append((lang, source))
                for piece in pieces(folded(text), PIECE):
                    held = waiting.setdefault(lang, [[], [], 0])
                    held[0].append(code)
                    held[1].append(piece)
                    held[2] += len(piece)
                    if held[2] >= PIECE:
                        walk(lang)
                        if sum(map(len, fresh)) > 8 * HELD:
                            keys, n = merged()
                            fresh.clear()
                            if len(keys) > HELD:
                                yield rows()
                                keys, n = keys[:0], n[:0]
            for lang in list(waiting):
                walk(lang)
        keys, n = merged()
        if len(keys):
            yield rows()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, ordinal bigint, n bigint")


def term_counts(docs: DataFrame, words: DataFrame) -> tuple[DataFrame, dict[str, list[int]]]:
    """(lang, source, ordinal, n) of all kept terms, and the first ordinal of each shard of each language."""
    shards = words.where("pos = -1").select("lang", "shard", "n", "size").orderBy("lang", "shard").collect()
    firsts: dict[str, list[int]] = {}
    first, total = {}, Counter()
    for s in shards:
        first[s["lang"], s["shard"]] = total[s["lang"]]
        firsts.setdefault(s["lang"], []).append(total[s["lang"]])
        total[s["lang"]] += s["n"]
    out = docs.sparkSession.createDataFrame([], "lang string, source string, ordinal bigint, n bigint")
    for batch in batches_of(shards):
        langs, numbers = sorted({s["lang"] for s in batch}), [(s["lang"], s["shard"]) for s in batch]
        data = words.where((F.col("pos") == -1) & F.col("lang").isin(langs)).select("lang", "shard", "transducer")
        data = [r for r in data.where(F.struct("lang", "shard").isin([F.struct(F.lit(k), F.lit(s)) for k, s in numbers])).collect()]
        tables = [(r["lang"], first[r["lang"], r["shard"]], bytes(r["transducer"])) for r in data]
        out = out.unionByName(recounted(docs.where(F.col("lang").isin(langs)), tables))
    return out.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), firsts


def rate(n, total, terms):
    """1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * terms)), in exact decimals."""
    wide = "decimal(20,0)"
    top = F.lit(UNIT).cast("decimal(10,0)") * (F.coalesce(n, F.lit(0)) + F.lit(SMOOTH)).cast(wide)
    whole = F.call_function("div", top, (F.coalesce(total, F.lit(0)) + F.lit(SMOOTH) * terms).cast(wide))
    return F.lit(1).cast("long") + whole.cast("long")


def pair_distances(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): summed differences of the rates of every two sources of a language.

    counts: lang, source, ordinal, p of what occurs; groups: lang, source, base (the rate of what does not), terms.
    """
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    placed = (groups.join(tiles, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
              .withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")}))
    keys = ["lang", "slice", "lo", "hi", "source", "tile"]
    last = F.greatest(F.floor((F.col("terms") - 1) / SLICE), F.lit(0)).cast("int")
    plain = (placed.withColumn("slice", F.explode(F.sequence(F.lit(0), last)))
             .select(*keys, F.lit(-1).alias("pos"), F.col("base").alias("p"),
                     F.greatest(F.least(F.col("terms") - F.col("slice") * SLICE, F.lit(SLICE)), F.lit(0)).alias("width")))
    found = (counts.join(placed.select("lang", "source", "tile", "lo", "hi"), ["lang", "source"])
             .withColumns({"slice": F.floor(F.col("ordinal") / SLICE).cast("int"), "pos": (F.col("ordinal") % SLICE).cast("int")})
             .select(*keys, "pos", "p", F.lit(None).cast("long").alias("width")))

    def part(key, group):
        lang, _, lo, hi = (k.as_py() for k in key)
        pos, p = group.column("pos").to_numpy(), group.column("p").to_numpy()
        coded = group.column("source").combine_chunks().dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        plain = pos < 0
        width = int(group.column("width").drop_null()[0].as_py())
        rates = np.zeros((len(names), width), np.int64)
        tile = np.zeros(len(names), np.int64)
        rates[code[plain]] = p[plain][:, None]
        tile[code[plain]] = group.column("tile").to_numpy()[plain]
        rates[code[~plain], pos[~plain]] = p[~plain]
        a, b, value = [], [], []
        right = np.flatnonzero(tile == hi)
        for i in np.flatnonzero(tile == lo).tolist():
            others = right[right > i] if lo == hi else right
            a += [names[i]] * len(others)
            b += [names[j] for j in others.tolist()]
            for j in range(0, len(others), 64):
                value.append(np.abs(rates[others[j: j + 64]] - rates[i]).sum(axis=1))
        lower = [min(x, y, key=str.encode) for x, y in zip(a, b)]
        upper = [max(x, y, key=str.encode) for x, y in zip(a, b)]
        value = np.concatenate(value) if value else np.zeros(0, np.int64)
        return pa.table([pa.array([lang] * len(a), pa.string()), pa.array(lower, pa.string()), pa.array(upper, pa.string()), pa.array(value, pa.int64())],
                        ["lang", "a", "b", "value"])

    parts = plain.unionByName(found).groupBy("lang", "slice", "lo", "hi").applyInArrow(part, "lang string, a string, b string, value bigint")
    whole = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return whole.select("lang", "value", F.inline(both)).select("lang", "source", "item", "value")


def divergences(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Rows lang, source, part, item, value, rank: distances to the other sources (``pair``) and the terms a source has more of (``term``)."""
    docs = groups_of(docs)
    kept = written(document_counts(docs).where(F.col("n") >= least).select("lang", "term"), "divergence-kept")
    words = written(vocabulary(kept), "divergence-words")
    counts, firsts = term_counts(docs, words)
    counts = written(counts, "divergence-counts")
    sizes = words.where("pos = -1").groupBy("lang").agg(F.sum("n").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
              .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms")))
    groups = written(groups, "divergence-groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    some = F.when(F.col("terms") > 0, rate(F.lit(0), F.col("total"), F.col("terms"))).otherwise(F.lit(1).cast("long"))
    rated = counts.join(groups, ["lang", "source"]).withColumn("p", rate(F.col("n"), F.col("total"), F.col("terms")))

    by = Window.partitionBy("lang", "source")
    pairs = pair_distances(rated.select("lang", "source", "ordinal", "p"), groups.select("lang", "source", some.alias("base"), "terms"))
    pairs = (pairs.withColumn("rank", F.row_number().over(by.orderBy(F.desc("value"), "item")))
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank"))

    overall = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("lang_n")).join(langs, "lang").join(sizes, "lang")
    overall = overall.select("lang", "ordinal", rate(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    over = rated.join(overall, ["lang", "ordinal"]).where("p > q").withColumn("value", F.col("p") - F.col("q"))
    ranked = over.withColumn("rank", F.row_number().over(by.orderBy(F.desc("value"), "ordinal"))).where(F.col("rank") <= top)
    offset = F.lit(0).cast("long")
    for lang, own in firsts.items():
        if len(own) > 1:
            offset = F.when(F.col("lang") == lang, F.element_at(F.array(*[F.lit(x).cast("long") for x in own]), F.col("shard") + 1)).otherwise(offset)
    named = words.where("pos >= 0").select("lang", (offset + F.col("pos")).alias("ordinal"), F.col("term").cast("string").alias("item"))
    terms = ranked.join(named, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
