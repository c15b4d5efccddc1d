"""Transducers against sorted lists; the source divergence audit against brute force, on awkward rows and in small parts."""
import collections
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import divergence
from tessera.llm.transducer import Transducer, Walker, folded, pieces

FIELDS = "doc_id bigint, text string, lang string, source string, ordinal string, p int, tile string, term string"


def walk(transducer, text):
    data = folded(text)
    buffer = np.frombuffer(b" " + data + b" ", np.uint8)
    gap = buffer == 32
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    token, ordinal = Walker(transducer).ordinals(buffer, starts)
    out = [None] * len(starts)
    for t, o in zip(token.tolist(), ordinal.tolist()):
        out[t] = o
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcé漢", min_size=1, max_size=6), min_size=1, max_size=40), st.lists(st.text("abcdé漢", min_size=1, max_size=7), max_size=30))
def test_transducer_gives_lexicographic_ordinals(words, others):
    terms = sorted({w.encode() for w in words})
    made = Transducer.from_bytes(Transducer.build(terms).to_bytes())
    text = [w.encode() for w in [*words, *others]]
    expected = {t: i for i, t in enumerate(terms)}
    assert walk(made, b" ".join(text)) == [expected.get(t) for t in text]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("ab", min_size=1, max_size=5), min_size=1, max_size=30))
def test_transducer_is_minimal(words):
    """As many states as there are different, non-empty sets of continuations."""
    made = Transducer.build(sorted(w.encode() for w in words))
    rest = {frozenset(w[len(p):] for w in words if w.startswith(p)) for x in words for p in (x[:i] for i in range(len(x) + 1))}
    assert len(made.final) - 2 == len(rest)


def test_transducer_refuses_unsorted_terms():
    with pytest.raises(ValueError):
        Transducer.build([b"b", b"a"])


def test_pieces_cut_at_separators():
    text = folded(b"Ab cd" * 50 + b"x" * 500 + b" end")
    parts = list(pieces(text, 64))
    assert b"".join(parts) == text and [w for p in parts for w in p.split()] == text.split()


def brute(rows, least, top):
    docs = [(t or "", k or "", s or "") for _, t, k, s, *_ in rows]
    terms = lambda t: re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    out = []
    for lang in {k for _, k, _ in docs}:
        df, counts = collections.Counter(), collections.defaultdict(collections.Counter)
        for t, k, s in docs:
            if k == lang:
                df.update(set(terms(t)))
                counts[s].update(terms(t))
        kept = [w for w, n in df.items() if n >= least]
        counts[None] = sum((c for s, c in list(counts.items())), collections.Counter())
        rate = {}
        for s, c in counts.items():
            n = sum(c[w] for w in kept)
            rate[s] = {w: 1 + 10**9 * (c[w] + 5) // (n + 5 * len(kept)) for w in kept}
        for s in counts:
            if s is None:
                continue
            pair = [(sum(abs(rate[s][w] - rate[o][w]) for w in kept), o) for o in counts if o not in (s, None)]
            term = [(rate[s][w] - rate[None][w], w) for w in kept if counts[s][w] and rate[s][w] > rate[None][w]]
            for part, found in (("pair", pair), ("term", sorted(term, key=lambda x: (-x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())))]
    return sorted(out)


def corpus():
    rng = np.random.default_rng(4)
    words = ["alpha", "Beta", "béta", "gamma", "漢字", "ÉTÉ", "été", "a", "zz", "zzz", "mid-word", "x1y", "🙂go"]
    rows = []
    for i in range(160):
        w = rng.choice(words, size=int(rng.integers(0, 14)), p=np.arange(1, 14) / 91)
        source = "hot" if i % 3 == 0 else str(rng.choice(["s1", "s2", "é", "z"]))
        rows.append((i, " ".join(w), str(rng.choice(["en", "fr"])), source, "x", 1, "t", "u"))
    rows += [(7, None, "en", "only-null", "x", 1, "t", "u"), (7, "", None, None, "x", 1, "t", "u"), (None, "alpha " * 3000, "en", None, "x", 1, "t", "u"),
             (8, "alpha", "xx", "s1", None, None, None, None), (8, "alpha", "xx", "s2", None, None, None, None)] + [rows[0]] * 3
    return rows


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, FIELDS).repartition(3)
    assert result(divergence.divergences(df, least=5, top=4)) == brute(rows, 5, 4)


def test_audit_in_small_shards_tiles_pieces_and_several_passes(spark, monkeypatch):
    for name, value in (("SHARD", 3), ("DRAWN", 2), ("TABLES", 1500), ("PIECE", 20), ("HELD", 5), ("TILE", 2), ("SLICE", 2)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus()
    df = spark.createDataFrame(rows, FIELDS).repartition(2)
    kept = divergence.document_counts(divergence.groups_of(df)).where("n >= 5").select("lang", "term").cache()
    shards = divergence.vocabulary(kept).where("pos = -1").select("lang", "shard", "n", "size").collect()
    assert len(shards) > 4 and len(divergence.batches_of(shards)) > 1
    assert result(divergence.divergences(df, least=5, top=4)) == brute(rows, 5, 4)


def test_audit_without_terms_and_without_rows(spark):
    rows = corpus()
    assert result(divergence.divergences(spark.createDataFrame(rows, FIELDS), least=10_000)) == brute(rows, 10_000, 50)
    assert divergence.divergences(spark.createDataFrame([], FIELDS)).count() == 0
