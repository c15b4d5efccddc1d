"""DuckDB SQL of the centroid clustering: its rounds as a chain of common table expressions."""
from __future__ import annotations

from tessera.llm.subvectors import DIM, K, ROUNDS, SCALE

_KEPT = f"""k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
x AS MATERIALIZED (SELECT r, i, CAST(floor(v[i] * {SCALE}) AS BIGINT) AS x FROM k, range(1, {DIM + 1}) AS d(i)),
f AS (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, r FROM k),
c0 AS MATERIALIZED (SELECT c, i, x AS m FROM f JOIN x USING (r) WHERE c < {K})"""


def _assigned(n: int) -> str:
    return f"""a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT r, c, sum((x - m) * (x - m)) AS d FROM x JOIN c{n} USING (i) GROUP BY r, c) GROUP BY r)"""


def _moved(n: int) -> str:
    # floor of an exact quotient: // cuts towards zero, so the remainder is taken out first
    return f"""s{n} AS (SELECT c, i, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM x JOIN a{n} USING (r) GROUP BY c, i),
c{n + 1} AS MATERIALIZED (SELECT c, i, CAST(coalesce((s - ((s % n) + n) % n) // n, m) AS BIGINT) AS m FROM c{n} LEFT JOIN s{n} USING (c, i))"""


CLUSTERING = f"""WITH {_KEPT}, {', '.join(f'{_assigned(n)}, {_moved(n)}' for n in range(ROUNDS))}, {_assigned(ROUNDS)},
h AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM k JOIN a{ROUNDS} USING (r) JOIN h USING (c)"""
