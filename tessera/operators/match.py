"""Similarity search: many lookups against the catalog, top-k for each.

Plan shape::

    catalog --clustered by bucket of the vector, first filter and cell--> packs of distinct vectors, stored   (once: PackedCatalog)
    lookups --packed by the filters that they set--> parts
    parts of the lookups x groups of packs --a task each: it holds the part, the packs stream past: matrix products-->
        top-k per (lookup, task), never all pairs
    --window(query_id)--> top-k, rank

A lookup is scored against the distinct vectors of the rows that pass its filters; packs that a task looks at together share equal
vectors. The k-th score so far is the least that any further row has to reach. Packs are read from where they are stored once for every part of the lookups, and the lookups
are shuffled once: what is written grows with the two, not with their pairs. Only lookups that come back empty are asked again without filters; if there are none, nothing is
read for that. With ``prune`` the nearest pack of each lookup is scored first; the k-th score so far then rules out the packs
in which no vector can be similar enough (``packs.upper_bounds``), so most packs of a clustered catalog are never scored.

Vectors are compared in single precision first, and again in double precision if they can be among the best by its bound on the error.

Ranking uses the similarity rounded to four decimals (the reported score) with ``product_id`` as the
tie-break, so equal scores order the same way on every engine.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions.plan import discard, stored
from tessera.functions.vectors import confidence_tier
from tessera.operators import packs as PK

DEFAULT_FILTERS = ("region", "vendor")
CAND_SCHEMA = "query_id long, product_id string, sim double, path int, extra double, q_limit int, cells long, asked long"

PATH_FILTERED = 0
PATH_FALLBACK = 1


@dataclass
class MatchConfig:
    k: int = fixed.DEFAULT_LIMIT          # default per-query limit
    cap: int = fixed.RESULT_CAP           # hard cap on results per query
    fallback_k: int = fixed.RESULT_CAP    # results on the degraded (unfiltered) path
    use_filters: bool = True              # apply the per-query region / vendor filters
    degrade: bool = True                  # unfiltered top-k when the filtered set is empty
    block_rows: int = 4096                # products per pack, at most
    query_block_rows: int = 8192          # queries per pack
    max_broadcast_bytes: int = 256 << 20  # without effect: lookups are never sent to every task
    score_chunk_cells: int = 4 << 20      # query x product cells scored per matrix product
    min_score: float | None = None        # keep only candidates with sim above this
    order_extra: bool = False             # rank by ``extra`` ascending instead of score
    filters: tuple = DEFAULT_FILTERS      # equality filters: query column = product column
    prune: bool = False                   # nearest packs first, then only packs that can still better the result
    cells: int = 0                        # vector cells by which a catalog is clustered for pruning


class PackedCatalog:
    """A catalog's packs, stored once and used by any number of searches with the same filters; ``unpersist`` deletes them."""

    def __init__(self, catalog: DataFrame, cfg: MatchConfig | None = None, extra_col: str | None = None):
        self.cfg, self.extra_col = cfg or MatchConfig(), extra_col
        rows = catalog.select("product_id", PK.vector_column(catalog).alias("embedding"),
                              *[F.col(f).cast("string").alias(f) for f in self.cfg.filters],
                              (F.col(extra_col).cast("double") if extra_col else F.lit(None).cast("double")).alias("extra"))
        rows = rows.where(PK.usable(F.col("embedding"))).withColumn("dim", F.size("embedding"))
        centres = PK.fit_cells(rows, self.cfg.cells) if self.cfg.cells else None
        keep, n_buckets = max(self.cfg.cap, self.cfg.fallback_k), PK.buckets(catalog.count(), self.cfg.cells)
        with PK.small_batches(catalog.sparkSession):
            self.packs = stored(PK.pack_catalog(PK.with_cell(rows, centres), self.cfg.filters, self.cfg.block_rows, keep, self.cfg.order_extra, n_buckets),
                                "packs", PK.PAGES)
        names = sum((F.length(F.array_join(v, "")) for v in (F.col("values")[i] for i in range(len(self.cfg.filters)))), F.lit(0))
        size = self.packs.agg(F.sum(F.length("vectors") + 16 * F.col("n_rows") + F.length(F.array_join("ids", "")) + names)).first()
        self.n_bytes = size[0] or 0

    def compatible(self, cfg: MatchConfig, extra_col: str | None) -> bool:
        return (tuple(cfg.filters) == tuple(self.cfg.filters) and extra_col == self.extra_col and cfg.order_extra == self.cfg.order_extra
                and max(cfg.cap, cfg.fallback_k) <= max(self.cfg.cap, self.cfg.fallback_k))

    def unpersist(self) -> None:
        discard(self.packs)


def _strings(x) -> pa.Array:
    return x if isinstance(x, pa.Array) else pa.array(x, pa.string())


class Group:
    """The packs that a task looks at together: by length, their vectors one after another, once, and the rows behind."""

    def __init__(self, packs, cfg: MatchConfig):
        self.cfg, held, rows = cfg, {}, {}
        for p in packs:
            # one buffer that grows in place: joining arrays at the end would hold every vector twice
            kind, of = held.setdefault(p["dim"], (PK.matrix(p["vectors"], p["n_vectors"], p["dim"]).dtype, bytearray()))
            of += p["vectors"]
            r = rows.setdefault(p["dim"], {"owner": [], "ids": [], "extra": [], "values": [], "packs": [], "n": 0})
            r["owner"].append(np.frombuffer(p["owner"], np.int32) + np.int32(r["n"]))
            r["ids"].append(_strings(p["ids"]))
            extra = p["extra"] if isinstance(p["extra"], pa.Array) else pa.array(p["extra"], pa.float64())
            r["extra"].append(extra.to_numpy(zero_copy_only=False).astype(np.float64))
            r["values"].append([_strings(v.values if isinstance(v, pa.ListScalar) else v) for v in p["values"]])
            r["packs"].append({"at": r["n"], "centroid": p["centroid"], "least": p["least"]})
            r["n"] += p["n_vectors"]
        self.held = {dim: np.frombuffer(of, kind).reshape(-1, dim) for dim, (kind, of) in held.items()}
        self.rows = {dim: Rows(self.held[dim], r, cfg) for dim, r in rows.items()}


class Rows:
    """Of a group, the rows with vectors of one length."""

    def __init__(self, held: np.ndarray, r: dict, cfg: MatchConfig):
        self.held, self.cfg = held, cfg
        self.owner, self.extra = np.concatenate(r["owner"]), np.concatenate(r["extra"])
        self.ids = pa.concat_arrays(r["ids"])
        self.values = [pa.concat_arrays([v[i] for v in r["values"]]).dictionary_encode() for i in range(len(r["values"][0]))]
        self.packs, self.begin = r["packs"], np.array([p["at"] for p in r["packs"]])
        self.same = None

    def alike(self) -> np.ndarray:
        """For each vector the number of the first one equal to it; with ``prune`` vectors of different packs stay apart."""
        if self.same is None:
            self.same = np.arange(len(self.held))
            if not self.cfg.prune:
                of = self.held.view(np.uint32)
                odd = np.random.default_rng(1).integers(1 << 62, size=of.shape[1], dtype=np.uint64) | np.uint64(1)
                key = np.concatenate([(of[a:a + ROWS_AT_ONCE] * odd).sum(axis=1, dtype=np.uint64) for a in range(0, len(of), ROWS_AT_ONCE)])
                _, first, found = np.unique(key, return_index=True, return_inverse=True)
                first = first[found.ravel()]
                for a in range(0, len(of), ROWS_AT_ONCE):
                    z = slice(a, a + ROWS_AT_ONCE)
                    self.same[z] = np.where((of[z] == of[first[z]]).all(axis=1), first[z], self.same[z])
        return self.same

    def units(self, own: np.ndarray) -> np.ndarray:
        """Unit vectors of the given numbers."""
        return PK.units(self.held[own])

    def units_as(self, own: np.ndarray, kind) -> np.ndarray:
        out = np.empty((len(own), self.held.shape[1]), kind)
        for a in range(0, len(own), ROWS_AT_ONCE):
            out[a:a + ROWS_AT_ONCE] = self.units(own[a:a + ROWS_AT_ONCE])
        return out

    def codes(self, mask: int, wanted: list) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the values of the filters of ``mask``, for each row and each lookup; -1: none, or in no row."""
        rows, asked = np.zeros(len(self.owner), np.int64), np.zeros(len(wanted[0]) if wanted else 0, np.int64)
        for i, values in enumerate(self.values):
            if mask >> i & 1:
                code = pc.fill_null(values.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
                want = pc.fill_null(pc.index_in(wanted[i], value_set=values.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                n = max(1, len(values.dictionary))
                rows, asked = (np.where((x < 0) | (y < 0), -1, x * n + y) for x, y in ((rows, code), (asked, want)))
                # numbers stay below the number of rows
                known = np.unique(rows[rows >= 0])
                rows = np.where(rows < 0, -1, np.searchsorted(known, rows))
                at = np.minimum(np.searchsorted(known, asked), max(0, len(known) - 1))
                asked = np.where(known[at] == asked, at, -1) if len(known) else np.full(len(asked), -1)
        return rows, asked

    def routes(self, mask: int, wanted: list, n_lookups: int, k: int):
        """(rows in order of their route, starts of the routes, each lookup's route or -1).

        Rows of a route with equal vectors lie next to each other. Those of one vector of one pack are in ranking order, so the first k will do.
        """
        if mask:
            code, asked = self.codes(mask, wanted)
            rows = np.flatnonzero(code >= 0)
        else:
            code, asked, rows = np.zeros(len(self.owner), np.int64), np.zeros(n_lookups, np.int64), np.arange(len(self.owner))
        vector = self.alike()[self.owner[rows]]
        order = np.argsort(code[rows] * len(self.held) + vector, kind="stable")
        rows = rows[order]
        key = np.stack([code[rows], self.owner[rows]])
        new = np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))[:len(rows)]
        at = np.arange(len(rows))
        rows = rows[at - np.maximum.accumulate(np.where(new, at, 0)) < k]
        n = int(code.max(initial=-1)) + 1
        return rows, np.searchsorted(code[rows], np.arange(n + 1)), asked

    def vectors(self, rows: np.ndarray):
        """(numbers of the distinct vectors of a route's rows, start of each, packs on the route)."""
        number = self.same[self.owner[rows]]
        starts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        packs = np.unique(np.searchsorted(self.begin, self.owner[rows], side="right") - 1)
        return number[starts], starts, packs


class Top:
    """The best vectors of each of some lookups: all that tie with or beat the k-th by rounded similarity (or, by_key, by a key of the vector).

    ``least``: keys known to be reached by k rows; ``slack``: bound on the error of the similarities offered.
    """

    def __init__(self, n: int, k: int, above: float | None, least: np.ndarray, slack: float = 0.0):
        self.k, self.above, self.found, self.slack = k, above, [], slack
        self.best, self.least = np.full((n, k), -np.inf), least.copy()

    def offer(self, rows: np.ndarray, S: np.ndarray, first: int) -> None:
        """Similarities of lookups ``rows`` with the vectors from ``first`` on."""
        if self.above is not None:
            S = np.where(S > self.above, S, -np.inf)
        near = NEARLY + self.slack
        better = np.flatnonzero(S.max(axis=1) >= self.least[rows] - near)
        if not len(better):
            return
        rows, S = rows[better], S[better]
        both = np.concatenate([self.best[rows], S], axis=1)
        best = -np.partition(-both, self.k - 1, axis=1)[:, : self.k]
        self.best[rows] = best
        self.least[rows] = np.maximum(self.least[rows], np.round(best.min(axis=1) - self.slack, 4))
        r, c = np.nonzero((S >= self.least[rows, None] - near) & (S > -np.inf))
        self.found.append((rows[r], c + first, S[r, c]))

    def offer_keyed(self, S: np.ndarray, first: int, key: np.ndarray) -> None:
        """Similarities of all lookups with vectors that are ranked by ``key``, given in falling order of it."""
        r, c = np.nonzero((S > (-np.inf if self.above is None else self.above)) & (key[None, :] >= self.least[:, None]))
        if len(r):
            n = np.searchsorted(r, np.arange(len(self.least) + 1))
            upto = np.arange(len(r)) - n[r]  # keys fall with c, so each row's come in order
            both = np.concatenate([self.best, np.full_like(self.best, -np.inf)], axis=1)
            new = upto < self.k
            both[r[new], self.k + upto[new]] = key[c[new]]
            self.best = -np.partition(-both, self.k - 1, axis=1)[:, : self.k]
            self.least = np.maximum(self.least, self.best.min(axis=1))
            stay = key[c] >= self.least[r]
            self.found.append((r[stay], c[stay] + first, S[r[stay], c[stay]]))

    def kept(self):
        """(lookup, vector, similarity) of what has been found."""
        if not self.found:
            return None
        r, c, s = (np.concatenate(x) for x in zip(*self.found))
        if len(self.found) > 1 and self.slack:
            ok = s >= self.least[r] - NEARLY - self.slack
            r, c, s = r[ok], c[ok], s[ok]
        return r, c, s


class Part:
    """The lookups that a task holds, and the best rows found so far for each."""

    def __init__(self, packs, k: int, by_extra: bool = False, above: float | None = None):
        self.k, self.by_extra, self.above, self.of = k, by_extra, above, {}
        held, n, ids, limits = {}, 0, [], []
        for q in packs:
            one = held.setdefault((q["dim"], q["mask"]), {"Q": bytearray(), "no": [], "wanted": []})
            m = len(q["q_ids"])
            one["Q"] += q["q_mat"]
            one["no"].append(np.arange(n, n + m))
            one["wanted"].append([_strings(w.values if isinstance(w, pa.ListScalar) else w) for w in q["wanted"]])
            ids.append(np.asarray(q["q_ids"], np.int64))
            limits.append(np.asarray(q["q_limits"], np.int64))
            n += m
        self.ids, self.limits = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (ids, limits))
        for (dim, mask), one in held.items():
            Q = np.frombuffer(one["Q"]).reshape(-1, dim)
            self.of[dim, mask] = (Q, np.concatenate(one["no"]), [pa.concat_arrays(w) for w in zip(*one["wanted"])])
        self.least = np.full(n, -np.inf)  # the k-th key of each lookup, if there are k
        self.kept, self.n_kept, self.after = [], 0, 0

    def take(self, no, rows, sim, extra, ids: pa.Array) -> None:
        """Rows of a group for lookups; those that cannot be among the best are left out."""
        key = -extra[rows] if self.by_extra else np.round(sim, 4)
        ok = key >= self.least[no]
        if self.above is not None:
            ok &= sim > self.above
        no, rows, sim, key = no[ok], rows[ok], sim[ok], key[ok]
        if not len(no):
            return
        order = np.lexsort((-key, no))
        no, rows, sim, key = no[order], rows[order], sim[order], key[order]
        begin = np.searchsorted(no, no)
        full = begin + self.k <= np.searchsorted(no, no, side="right")
        last = key[np.minimum(begin + self.k, len(no)) - 1]
        self.least[no[full]] = np.maximum(self.least[no[full]], last[full])
        ok = key >= self.least[no]
        no, rows, sim = no[ok], rows[ok], sim[ok]
        self.kept.append((no.astype(np.int32), sim, extra[rows], ids.take(pa.array(rows))))
        self.n_kept += len(no)
        if self.n_kept > max(TIED_ROWS, 2 * self.after):
            self.cut()

    def cut(self):
        """(lookup, similarity, extra, id) of the k best rows of each lookup, in order; all that is kept from now on."""
        if not self.kept:
            return None
        no, sim, extra = (np.concatenate([x[i] for x in self.kept]) for i in range(3))
        ids = pa.concat_arrays([x[3] for x in self.kept])
        self.kept = []
        key = -extra if self.by_extra else np.round(sim, 4)
        at = np.flatnonzero(key >= self.least[no])
        place = pc.rank(ids.take(pa.array(at)), tiebreaker="dense").to_numpy()
        at = at[np.lexsort((place, -key[at], no[at]))]
        at = at[np.arange(len(at)) - np.searchsorted(no[at], no[at]) < self.k]
        full = np.flatnonzero(np.bincount(no[at], minlength=len(self.least)) == self.k)
        self.least[full] = np.maximum(self.least[full], key[at][np.searchsorted(no[at], full, side="right") - 1])
        self.kept, self.n_kept = [(no[at], sim[at], extra[at], ids.take(pa.array(at)))], len(at)
        self.after = self.n_kept
        return self.kept[0]


def _score(cfg: MatchConfig, path: int, k: int):
    """Body of a ``grid``: the best k of each lookup of a part among the packs of a group, and a row with what was scored."""
    exact = cfg.order_extra or cfg.min_score is not None

    def scored(at, Q, Q1, own, U, cuts, of_packs, key, no, part):
        """(found, pairs of lookup and pack, cells) of the lookups ``at`` of a route with its vectors; Q1, U: in the precision of a first look."""
        top = Top(len(at), k, cfg.min_score, part.least[no[at]], 0.0 if exact else (Q.shape[1] + 16) * 2.0 ** -24)
        q = Q1[at]
        if key is not None or not cfg.prune:
            for a in range(0, len(own), SCORE_VECTORS):
                S = q @ U[a:a + SCORE_VECTORS].T
                if key is not None:
                    top.offer_keyed(S, a, key[a:a + SCORE_VECTORS])
                else:
                    top.offer(np.arange(len(at)), S, a)
            return top.kept(), len(at) * len(of_packs), len(at) * len(own)
        bound = np.round(PK.upper_bounds(Q[at], of_packs), 4)
        near = (Q[at] @ np.frombuffer(b"".join(p["centroid"] for p in of_packs)).reshape(-1, Q.shape[1]).T).argmax(axis=1)
        asked = cells = 0
        for seen in (True, False):
            need = bound >= top.least[:, None]
            need &= (near[:, None] == np.arange(len(of_packs))) == seen
            if cfg.min_score is not None:
                need &= bound > cfg.min_score - 1e-4
            for j in np.flatnonzero(need.any(axis=0)):
                rows = np.flatnonzero(need[:, j])
                rows = rows[bound[rows, j] >= top.least[rows]]
                if len(rows):
                    a, b = cuts[j], cuts[j + 1]
                    top.offer(rows, q[rows] @ U[a:b].T, a)
                    asked, cells = asked + len(rows), cells + len(rows) * (b - a)
        return top.kept(), asked, cells

    def route(g, rows, at, Q, Q1, no, part):
        """(pairs of lookup and pack, cells) of the lookups ``at`` with the rows of their route."""
        own, starts, packs = g.vectors(rows)
        size, key = np.diff(np.append(starts, len(rows))), None
        if cfg.order_extra:
            key = -np.minimum.reduceat(g.extra[rows], starts)
            order = np.argsort(-key, kind="stable")
            own, starts, size, key = own[order], starts[order], size[order], key[order]
        cuts = np.searchsorted(own, np.append(g.begin[packs], len(g.held))) if cfg.prune and key is None else None
        U, asked, cells = g.units_as(own, Q1.dtype), 0, 0
        step = max(1, cfg.score_chunk_cells // max(SCORE_VECTORS, len(packs)))
        step = min(step, PRUNE_LOOKUPS if cuts is not None else SCORE_LOOKUPS)
        for s in range(0, len(at), step):
            some = at[s:s + step]
            found, n_asked, n_cells = scored(some, Q, Q1, own, U, cuts, [g.packs[j] for j in packs], key, no, part)
            asked, cells = asked + n_asked, cells + n_cells
            if found is not None:
                take(g, rows, some, own, starts, size, key, *found, Q, no, part)
        return asked, cells

    def take(g, rows, at, own, starts, size, key, r, c, sim, Q, no, part):
        """Hand on the rows behind the best vectors found: exact similarities, then vectors by falling key until k rows are behind them."""
        if not exact:
            sim = np.concatenate([np.einsum("ij,ij->i", Q[at[r[a:a + ROWS_AT_ONCE]]], g.units(own[c[a:a + ROWS_AT_ONCE]]))
                                  for a in range(0, len(r), ROWS_AT_ONCE)] + [np.zeros(0)])
        by = np.round(sim, 4) if key is None else key[c]
        order = np.lexsort((-by, r))
        r, c, sim, by = r[order], c[order], sim[order], by[order]
        # the key of the vector with which k rows are reached
        rows_of = size[c] if key is None else np.ones(len(c), np.int64)
        upto = np.cumsum(rows_of)
        begin, end = np.searchsorted(r, r), np.searchsorted(r, r, side="right")
        last = np.searchsorted(upto, upto[begin] - rows_of[begin] + k)
        ok = by >= by[np.minimum(last, end - 1)]
        r, c, sim = r[ok], c[ok], sim[ok]
        n, a = np.cumsum(size[c]), 0
        while a < len(r):
            b = max(a + 1, int(np.searchsorted(n, n[a] - size[c[a]] + TIED_ROWS, side="right")))
            m = size[c[a:b]]
            behind = rows[np.repeat(starts[c[a:b]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
            part.take(no[np.repeat(at[r[a:b]], m)], behind, np.repeat(sim[a:b], m), g.extra, g.ids)
            a = b

    def one_by_one(g, rows, starts, asked, at, Q, no, part):
        """(pairs of lookup and pack, cells) of lookups on routes of few lookups and rows."""
        size = (starts[1:] - starts[:-1])[asked[at]]
        n, a, pairs, cells = np.cumsum(size), 0, 0, 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(n, n[a] - size[a] + PAIRS, side="right")))
            m = size[a:b]
            lookup = np.repeat(at[a:b], m)
            row = rows[np.repeat(starts[asked[at[a:b]]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
            sim = np.einsum("ij,ij->i", Q[lookup], g.units(g.owner[row]))
            part.take(no[lookup], row, sim, g.extra, g.ids)
            pairs += len(np.unique(lookup * len(g.packs) + np.searchsorted(g.begin, g.owner[row], side="right")))
            a, cells = b, cells + len(row)
        return pairs, cells

    def met(g, Q, Q1, no, wanted, mask, part):
        rows, starts, asked = g.routes(mask, wanted, len(Q), k)
        n_rows, n_asked = np.diff(starts), np.bincount(asked[asked >= 0], minlength=len(starts) - 1)
        few = n_rows * n_asked <= FEW_PAIRS
        has = asked >= 0
        pairs = cells = 0
        at = np.flatnonzero(has)
        at = at[few[asked[at]]]
        if len(at):
            pairs, cells = one_by_one(g, rows, starts, asked, at, Q, no, part)
        for j in np.flatnonzero(~few & (n_asked > 0) & (n_rows > 0)):
            did = route(g, rows[starts[j]:starts[j + 1]], np.flatnonzero(asked == j), Q, Q1, no, part)
            pairs, cells = pairs + did[0], cells + did[1]
        return pairs, cells

    def score(batches):
        cells = asked = 0
        for kinds in PK.cells(batches):
            part, first = None, {}
            for kind, of_kind in kinds:
                if kind == 0:
                    part = Part(of_kind, k, cfg.order_extra, cfg.min_score)
                    first = {key: Q if exact else Q.astype(np.float32) for key, (Q, *_) in part.of.items()}
                    continue
                for some in PK.held_together(of_kind if part and k > 0 else ()):
                    group = Group(some, cfg)
                    for (dim, mask), (Q, no, wanted) in part.of.items():
                        if dim in group.rows:
                            did = met(group.rows[dim], Q, first[dim, mask], no, wanted, mask, part)
                            asked, cells = asked + did[0], cells + did[1]
            best = part.cut() if part else None
            if best is not None:
                no, sim, extra, ids = best
                for a in range(0, len(no), ROWS_AT_ONCE):
                    z = slice(a, a + ROWS_AT_ONCE)
                    none = pa.nulls(len(no[z]), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part.ids[no[z]]), ids[z], pa.array(sim[z], pa.float64()), pa.array(np.full(len(no[z]), path), pa.int32()),
                         pa.array(extra[z], pa.float64(), from_pandas=True), pa.array(part.limits[no[z]], pa.int32()), none, none], NAMES)
        one = {"cells": cells, "asked": asked}
        yield pa.RecordBatch.from_arrays([pa.array([one.get(n)], t) for n, t in zip(NAMES, TYPES)], NAMES)

    return score


SCORE_VECTORS = 512  # vectors of a matrix product
SCORE_LOOKUPS = 256  # lookups of a matrix product, at most
PRUNE_LOOKUPS = 4096  # lookups that packs are chosen for at once
FEW_PAIRS = 4096  # pairs of lookup and row up to which a route is no matrix product
PAIRS = 1 << 14  # pairs of lookup and row that are worked out one by one at once
ROWS_AT_ONCE = 1 << 13  # vectors or rows that a step copies
TIED_ROWS = 1 << 17  # rows that are kept before they are cut to the best, and rows behind vectors that are looked at together
NEARLY = 0.5e-4 + 1e-9  # a similarity so much below a rounded one may round to it
NAMES = ["query_id", "product_id", "sim", "path", "extra", "q_limit", "cells", "asked"]
TYPES = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]


def _lookups(queries: DataFrame, cfg: MatchConfig) -> DataFrame:
    limit = F.coalesce(F.col("q_limit").cast("int"), F.lit(cfg.k)) if "q_limit" in queries.columns else F.lit(cfg.k)
    wanted = [(F.coalesce(F.col(f).cast("string"), F.lit("")) if cfg.use_filters and f in queries.columns else F.lit("")).alias(f"w_{f}")
              for f in cfg.filters]
    return (queries.where(PK.usable(F.col("embedding")))
            .select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"),
                    limit.alias("q_limit"), F.size("embedding").alias("dim"), *wanted))


class Search:
    """Candidates of a search, stored: ``cands`` (some for every answered lookup), ``n_lookups``, and what was scored."""

    def __init__(self, queries: DataFrame, catalog: DataFrame | PackedCatalog, cfg: MatchConfig | None = None, extra_col: str | None = None):
        self.cfg = cfg = cfg or MatchConfig()
        fits = isinstance(catalog, PackedCatalog) and catalog.compatible(cfg, extra_col)
        if isinstance(catalog, PackedCatalog) and not fits:
            raise ValueError("the packed catalog was made for other filters, another order or fewer results")
        self.catalog = catalog if fits else PackedCatalog(catalog, cfg, extra_col)
        self.kept = [] if fits else [self.catalog.packs]
        lookups = self._store(_lookups(queries, cfg), "lookups")
        self.n_lookups, size = lookups.agg(F.count("*"), F.sum(8 * F.col("dim") + 12)).first()
        self.lookup_bytes = (size or 0) / max(1, self.n_lookups)
        self.cands = self._pass(lookups, self.n_lookups, PATH_FILTERED, cfg.cap)
        if cfg.use_filters and cfg.degrade:
            answered = self.cands.where("q_limit > 0").select("query_id").distinct()
            n_left = self.n_lookups - answered.count()
            if n_left > 0:
                left = lookups.join(answered, "query_id", "left_anti").withColumns({f"w_{f}": F.lit("") for f in cfg.filters})
                self.cands = self.cands.unionByName(self._pass(left, n_left, PATH_FALLBACK, cfg.fallback_k))

    def _store(self, df: DataFrame, name: str) -> DataFrame:
        self.kept.append(stored(df, name))
        return self.kept[-1]

    def _pass(self, lookups: DataFrame, n: int, path: int, k: int) -> DataFrame:
        asked = PK.pack_lookups(lookups, self.cfg.filters, min(self.cfg.query_block_rows, PK.LOOKUP_ROWS))
        packs = self.catalog.packs.select("pblock", "dim", "n_vectors", "vectors", "ids", "owner", "values", "extra", "centroid", "least")
        shape = PK.grid_shape(packs.sparkSession, self.catalog.n_bytes, n, int(n * self.lookup_bytes))
        with PK.small_batches(packs.sparkSession, stored_packs=True):
            return self._store(PK.grid(packs, asked, shape, _score(self.cfg, path, k), CAND_SCHEMA), "candidates")

    def hits(self) -> DataFrame:
        """(query_id, rank, product_id, sim, extra, degraded)."""
        out = rank_candidates(self.cands, self.cfg)
        out._rows_bound = self.n_lookups * max(self.cfg.cap, self.cfg.fallback_k)  # checked bound on the rows
        return out

    def report(self) -> DataFrame:
        """One row: lookups, products, packs, the grid of lookups and products, cells scored, pairs of lookup and pack, and those scored."""
        packs = self.catalog.packs.agg(F.sum("n_given").alias("products"), F.count("*").alias("packs"))
        did = self.cands.agg(F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"), F.coalesce(F.sum("asked"), F.lit(0)).alias("asked"))
        n = F.lit(self.n_lookups).cast("long")
        return packs.join(F.broadcast(did)).select(n.alias("lookups"), "products", "packs", (n * F.col("products")).alias("grid"), "cells",
                                                   (n * F.col("packs")).alias("pairs"), "asked")

    def trim(self) -> None:
        """Delete the packs and lookups that the search stored; its results can still be read, its report not."""
        gone = [x for x in self.kept if not x._stored_at.rsplit("/", 1)[-1].startswith("candidates-")]
        self.kept = [x for x in self.kept if all(x is not y for y in gone)]
        discard(*gone)

    def close(self) -> None:
        """Delete what the search stored; its results cannot be read after that."""
        discard(*self.kept)


def rank_candidates(cands: DataFrame, cfg: MatchConfig | None = None) -> DataFrame:
    """Global top-k per query from local candidates.

    One window on ``query_id`` ordered by (path, key, product_id) with a
    literal bound K = max(cap, fallback_k): Spark plans a WindowGroupLimit,
    so at most K rows per query and map task cross the shuffle however many
    packs produced candidates. The filtered path comes first in that order,
    so the rows kept are the filtered ones when there are any, else the
    fallback ones (flagged ``degraded``). The filtered path is then cut at
    ``min(limit, cap)``, the fallback at ``fallback_k``.
    """
    cfg = cfg or MatchConfig()
    big_k = max(cfg.cap, cfg.fallback_k)
    key = F.col("extra").asc() if cfg.order_extra else F.round("sim", 4).desc()
    w_rank = Window.partitionBy("query_id").orderBy(F.col("path").asc(), key, F.col("product_id").asc())
    # a limit of 0 or below returns nothing on the filtered path, which is what sends a lookup
    # to the fallback in the behaviour reproduced
    cands = cands.where(F.col("query_id").isNotNull() & ((F.col("path") != PATH_FILTERED) | (F.col("q_limit") > 0)))
    top = cands.withColumn("rank", F.row_number().over(w_rank)).where(F.col("rank") <= F.lit(big_k))
    # same partitioning (query_id) as the window above: no further shuffle
    top = top.withColumn("best_path", F.min("path").over(Window.partitionBy("query_id")))
    k_eff = F.when(F.col("path") == PATH_FILTERED, F.least(F.col("q_limit"), F.lit(cfg.cap))) \
             .otherwise(F.lit(cfg.fallback_k))
    return (top.where((F.col("path") == F.col("best_path")) & (F.col("rank") <= k_eff))
               .select("query_id", F.col("rank").cast("int").alias("rank"), "product_id", "sim", "extra",
                       ((F.col("path") == PATH_FALLBACK) & F.lit(cfg.use_filters)).alias("degraded")))


def top_k(queries: DataFrame, catalog, cfg: MatchConfig | None = None,
          extra_col: str | None = None) -> DataFrame:
    """(query_id, rank, product_id, sim, extra, degraded) for every query with a usable vector.

    queries: query_id long, embedding array, filter columns?, q_limit int?
    catalog: product_id string, embedding array, filter columns; or a PackedCatalog
    """
    search = Search(queries, catalog, cfg, extra_col)
    search.trim()
    return search.hits()


MAX_BROADCAST_HITS = 200_000  # result rows; about 100 bytes each before the display columns

DISPLAY_COLUMNS = ["material_name", "description", "unit_price", "unit", "region", "vendor",
                   "vat_rate", "quality_score", "updated_at", "source"]


def attach_products(hits: DataFrame, catalog: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Join the display columns back on product_id and add score and tier."""
    columns = columns or DISPLAY_COLUMNS
    display = catalog.select("product_id", *columns)
    bound = getattr(hits, "_rows_bound", None)
    if bound is not None and bound <= MAX_BROADCAST_HITS:
        # at most queries x k rows, counted when the plan was built: broadcast them and
        # stream the catalog through instead of shuffling it on product_id
        hits = F.broadcast(hits)
    return (hits.join(display, "product_id")
                .withColumn("similarity_score", F.round("sim", 4))
                .withColumn("confidence_tier", confidence_tier(F.col("sim"))))


def empty_queries(queries: DataFrame) -> DataFrame:
    """Queries whose text or vector is empty: no result rows, a reason instead."""
    return (queries.where((F.coalesce(F.col("query"), F.lit("")) == "") | (F.size("embedding") <= 0))
                   .select(F.col("query_id").cast("long").alias("query_id"),
                           F.lit("empty_query").alias("reason")))


def with_vector_reason(rows: DataFrame) -> DataFrame:
    """``rows`` with ``reason``: why the vector cannot be scored, null if it can.

    First that holds: missing_vector (null or empty), not_finite (a null, NaN or infinite
    element), zero_vector, odd_length (not the most common length of the scorable rows; of
    equally common ones the shorter). The exact search still matches odd lengths with
    vectors of their own length.
    """
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    reason = (F.when(F.coalesce(F.size(v), F.lit(0)) <= 0, F.lit("missing_vector"))
               .when(bad, F.lit("not_finite"))
               .when(~F.exists(v, lambda x: x != 0), F.lit("zero_vector")))
    usual = (rows.where(reason.isNull()).groupBy(F.size(v).alias("_len")).agg(F.count("*").alias("_n"))
                 .agg(F.max_by("_len", F.struct("_n", -F.col("_len"))).alias("_usual")))
    return (rows.join(F.broadcast(usual))  # one row
                .withColumn("reason", F.coalesce(reason, F.when(F.size(v) != F.col("_usual"), F.lit("odd_length"))))
                .drop("_usual"))


def vector_rejects(rows: DataFrame, id_col: str = "product_id") -> DataFrame:
    """(id, reason) of the rows whose vector cannot be scored."""
    return with_vector_reason(rows).where(F.col("reason").isNotNull()).select(id_col, "reason")
