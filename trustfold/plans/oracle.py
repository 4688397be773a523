"""DuckDB SQL text of the catalogue queries (the correctness oracle).

These strings restate each query in plain SQL over the driver's tables so
that an independent engine can check the Spark result.  Every DOUBLE
literal is cast explicitly (DuckDB reads ``0.1`` as DECIMAL).
"""

from __future__ import annotations

import math

from trustfold.functions.rules import LABEL_SQL
from trustfold.operators.learned import DIGITS, N_TREES, SUBSAMPLE
from trustfold.operators.detectors import HBOS_ALPHA, HBOS_BINS, KNN_K, LODA_BIN_CHOICES
from trustfold.sources.tables import LOG_SQL


def d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


LABELLED = f"(SELECT *, {LABEL_SQL} AS True_Class, lower({LABEL_SQL}) AS Dataset_Source FROM {LOG_SQL} l0)"


def step_lambda(inc: float, p1: float, p2: float, src: str = "x") -> str:
    return (
        f"lambda a, {src}: CASE WHEN {src} = 'normal' THEN least({d(1.0)}, a + {d(inc)}) "
        f"WHEN {src} = 'unintentional' THEN greatest({d(0.0)}, a - {d(p1)}) "
        f"WHEN {src} = 'intentional' THEN greatest({d(0.0)}, a - {d(p2)}) ELSE a END"
    )


def chunked(src: str, percent: float = 0.1) -> str:
    return f"""(SELECT * EXCLUDE (_i, _cnt, _n, _q, _r),
        CAST(CASE WHEN _i < _r * (_q + 1) THEN _i // (_q + 1) ELSE _r + (_i - _r * (_q + 1)) // greatest(_q, 1) END AS INTEGER) AS chunk_id
   FROM (SELECT *, _cnt // _n AS _q, _cnt % _n AS _r
           FROM (SELECT *, greatest(1, _cnt // greatest(1, CAST(floor(_cnt * {d(percent)}) AS BIGINT))) AS _n
                   FROM (SELECT *, row_number() OVER (ORDER BY "Timestamp", row_id) - 1 AS _i, count(*) OVER () AS _cnt
                           FROM {src} c0) c1) c2) c3)"""


def long_form(src: str, numeric=("value", "k"), onehot=("event_type",), label=()) -> str:
    parts = [f"SELECT chunk_id, row_id, '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM {src} lf" for c in numeric]
    for c in onehot:
        parts.append(
            f"SELECT chunk_id, row_id, '{c}_' || cats.c AS \"column\", COALESCE(CAST(lf.{c} = cats.c AS DOUBLE), {d(0.0)}) AS value "
            f"FROM {src} lf CROSS JOIN (SELECT DISTINCT {c} AS c FROM {src} WHERE {c} IS NOT NULL) cats"
        )
    for c in label:
        parts.append(f"SELECT chunk_id, row_id, '{c}' AS \"column\", CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS DOUBLE) AS value FROM {src} lf")
    body = "\n UNION ALL ".join(parts)
    return f"""(SELECT chunk_id, row_id, "column",
        COALESCE(value, quantile_cont(value, {d(0.5)}) OVER (PARTITION BY chunk_id, "column")) AS value
   FROM ({body}) lf0)"""


W = 'PARTITION BY chunk_id, "column"'


def zscore(src: str, t: float) -> str:
    return f"""(SELECT chunk_id, row_id, "column",
        abs((value - m) / CASE WHEN sd = 0 THEN {d(1e-9)} ELSE sd END) > {d(t)} AS is_outlier
   FROM (SELECT *, avg(value) OVER ({W}) AS m, stddev_pop(value) OVER ({W}) AS sd FROM {src} z0) z1)"""


def iqr(src: str, t: float) -> str:
    return f"""(SELECT chunk_id, row_id, "column",
        (value < q1 - {d(t)} * (q3 - q1)) OR (value > q3 + {d(t)} * (q3 - q1)) AS is_outlier
   FROM (SELECT *, quantile_cont(value, {d(0.25)}) OVER ({W}) AS q1, quantile_cont(value, {d(0.75)}) OVER ({W}) AS q3
           FROM {src} i0) i1)"""


def mad(src: str, t: float) -> str:
    return f"""(SELECT chunk_id, row_id, "column",
        abs({d(0.6745)} * (value - med) / CASE WHEN md = 0 THEN {d(1e-9)} ELSE md END) > {d(t)} AS is_outlier
   FROM (SELECT *, quantile_cont(abs(value - med), {d(0.5)}) OVER ({W}) AS md
           FROM (SELECT *, quantile_cont(value, {d(0.5)}) OVER ({W}) AS med FROM {src} m0) m1) m2)"""


def flags_from_scores(scored: str, c: float) -> str:
    return f"""(SELECT chunk_id, row_id, "column", COALESCE(score > thr, FALSE) AS is_outlier
   FROM (SELECT *, quantile_cont(score, {d(1.0 - c)}) OVER ({W}) AS thr FROM {scored} f0) f1)"""


def _binned(src: str, k: str) -> str:
    return (f"CASE WHEN mx = mn THEN 0 ELSE least(CAST(floor((value - mn) / ((mx - mn) / {k})) AS INTEGER), {k} - 1) END")


def hbos(src: str, c: float) -> str:
    scored = f"""(SELECT *, -log2(nb / (n * CASE WHEN mx = mn THEN {d(1.0)} ELSE (mx - mn) / {HBOS_BINS} END) + {d(HBOS_ALPHA)}) AS score
   FROM (SELECT *, count(*) OVER (PARTITION BY chunk_id, "column", b) AS nb
           FROM (SELECT *, {_binned(src, str(HBOS_BINS))} AS b
                   FROM (SELECT *, min(value) OVER ({W}) AS mn, max(value) OVER ({W}) AS mx, count(*) OVER ({W}) AS n
                           FROM {src} h0) h1) h2) h3)"""
    return flags_from_scores(scored, c)


def knn(src: str, c: float, k: int = KNN_K) -> str:
    o = f"OVER ({W} ORDER BY value, row_id)"
    cands = []
    for j in range(k + 1):
        left = f"value - lag(value, {j}) {o}" if j else d(0.0)
        right = f"lead(value, {k - j}) {o} - value" if k - j else d(0.0)
        conds = []
        if j:
            conds.append(f"lag(value, {j}) {o} IS NOT NULL")
        if k - j:
            conds.append(f"lead(value, {k - j}) {o} IS NOT NULL")
        cands.append(f"CASE WHEN {' AND '.join(conds)} THEN greatest({left}, {right}) END")
    scored = f"(SELECT *, least({', '.join(cands)}) AS score FROM {src} k0)"
    return flags_from_scores(scored, c)


def loda(src: str, c: float, choices=LODA_BIN_CHOICES) -> str:
    ks = ", ".join(f"({k})" for k in choices)
    scored = f"""(WITH x AS (SELECT *, min(value) OVER ({W}) AS mn, max(value) OVER ({W}) AS mx, count(*) OVER ({W}) AS n
                FROM {src} x0),
       kb AS (SELECT x.*, ks.k, {_binned('x', 'ks.k')} AS b FROM x CROSS JOIN (VALUES {ks}) ks(k)),
       cnt AS (SELECT chunk_id, "column", k, b, count(*) AS nb, any_value(n) AS n FROM kb GROUP BY ALL),
       crit AS (SELECT chunk_id, "column", k, sum(nb * ln(k * nb / n)) - (k - 1 + pow(ln(k), {d(2.5)})) AS crit
                  FROM cnt GROUP BY chunk_id, "column", k),
       best AS (SELECT chunk_id, "column", arg_min(k, (-crit, k)) AS k FROM crit GROUP BY ALL)
  SELECT kb.chunk_id, kb.row_id, kb."column", -ln(cnt.nb / cnt.n) AS score
    FROM kb JOIN best USING (chunk_id, "column", k) JOIN cnt USING (chunk_id, "column", k, b))"""
    return flags_from_scores(scored, c)


def hashed(seed: str, *keys: str) -> str:
    """SQL twin of ``scalars.hashed_uniform`` over keys joined by #."""
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST(('0x' || substring(md5(concat_ws('#', '{seed}', {parts})), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"


def iforest(src: str, c: float, trees: int = N_TREES, size: int = SUBSAMPLE) -> str:
    """The forest level by level: rows of all trees' samples carry their node and its lower bound."""
    depth = math.ceil(math.log2(size))
    group = 'chunk_id, "column"'
    correction = lambda n: f"CASE WHEN {n} <= 1 THEN {d(0.0)} ELSE 2.0 * (ln({n} - 1) + {d(0.5772156649)}) - 2.0 * ({n} - 1) / {n} END"
    ctes = [f"""src AS (SELECT chunk_id, row_id, "column", value, greatest(1, CAST(ceil(count(*) OVER ({W}) / {d(float(size))}) AS BIGINT)) AS sets FROM {src} i0)""",
            f"""dealt AS (SELECT *, round_no * sets + CAST(floor({hashed('tree', 'round_no', 'row_id')} * sets) AS BIGINT) AS tree
                FROM (SELECT *, unnest(range(0, CAST(ceil({trees} / CAST(sets AS DOUBLE)) AS BIGINT))) AS round_no FROM src) i1)""",
            f"""s0 AS (SELECT {group}, tree, value, CAST(1 AS BIGINT) AS node, CAST('-infinity' AS DOUBLE) AS low FROM dealt WHERE tree < {trees})"""]
    for k in range(depth + 1):
        split = "n > 1 AND mn < mx" if k < depth else "FALSE"
        ctes.append(f"""n{k} AS (SELECT *, mn + {hashed('cut', 'chunk_id', '"column"', 'tree', 'node')} * (mx - mn) AS cut, {split} AS split
                FROM (SELECT {group}, tree, node, any_value(low) AS low, count(*) AS n, min(value) AS mn, max(value) AS mx FROM s{k} GROUP BY ALL) i2)""")
        if k < depth:
            ctes.append(f"""s{k + 1} AS (SELECT s.chunk_id, s."column", s.tree, s.value, 2 * s.node + CAST(s.value >= cut AS BIGINT) AS node,
                CASE WHEN s.value >= cut THEN cut ELSE s.low END AS low FROM s{k} s JOIN n{k} USING ({group}, tree, node) WHERE split)""")
    leaves = " UNION ALL ".join(f"SELECT {group}, tree, low, {k} + {correction('n')} AS path FROM n{k} WHERE NOT split" for k in range(depth + 1))
    ctes += [f"leaves AS ({leaves})",
             f"""sized AS (SELECT {group}, least({size}, max(m)) AS size, count(*) AS trees FROM (SELECT {group}, tree, count(*) AS m FROM s0 GROUP BY ALL) i3 GROUP BY {group})""",
             f"""points AS (SELECT {group}, value, tree FROM (SELECT DISTINCT {group}, value FROM src) i4 JOIN (SELECT DISTINCT {group}, tree FROM s0) i5 USING ({group}))""",
             f"""paths AS (SELECT p.chunk_id, p."column", p.value, sum(l.path) AS total FROM points p
                ASOF JOIN leaves l ON p.chunk_id = l.chunk_id AND p."column" = l."column" AND p.tree = l.tree AND p.value >= l.low GROUP BY ALL)""",
             f"""scored AS (SELECT {group}, value, round(pow({d(2.0)}, -(total / trees) / greatest({correction('size')}, {d(1e-12)})), {DIGITS}) AS score
                FROM paths JOIN sized USING ({group}))"""]
    return flags_from_scores(f"(WITH {', '.join(ctes)} SELECT src.chunk_id, src.row_id, src.\"column\", scored.score FROM src JOIN scored USING ({group}, value))", c)


METHOD_SQL = {"HBOS": (0, hbos), "kNN": (1, knn), "LODA": (3, loda), "Z-Score": (5, zscore), "IQR": (6, iqr), "MAD": (7, mad)}


def all_flags(src: str, c: float, t: float, own: dict | None = None) -> str:
    parts = []
    for name, (prio, fn) in {**METHOD_SQL, **(own or {})}.items():
        arg = t if name in ("Z-Score", "IQR", "MAD") else c
        parts.append(f"SELECT chunk_id, row_id, \"column\", '{name}' AS method, {prio} AS priority, is_outlier FROM {fn(src, arg)} q_{prio}")
    return "(" + "\n UNION ALL ".join(parts) + ")"


def metrics(flags: str) -> str:
    return f"""(SELECT chunk_id, "column", method, priority, count(*) AS original_size,
        count(*) FILTER (WHERE is_outlier) AS outliers_removed,
        count(*) - count(*) FILTER (WHERE is_outlier) AS cleaned_size
   FROM {flags} fm GROUP BY ALL)"""


def best(m: str) -> str:
    return f"""(SELECT * EXCLUDE (_med, _r) FROM (
   SELECT *, row_number() OVER (PARTITION BY chunk_id, "column" ORDER BY abs(outliers_removed - _med), priority) AS _r
     FROM (SELECT *, quantile_cont(CAST(outliers_removed AS DOUBLE), {d(0.5)}) OVER (PARTITION BY chunk_id, "column") AS _med
             FROM {m} b0) b1) b2 WHERE _r = 1)"""


def consensus_ctes(p, log: str = LOG_SQL, label=(), own: dict | None = None) -> str:
    """WITH-list: log, ch, lng, flg, met, bst, flagged, normal, mis.  ``own``: further methods, name -> (priority, SQL function)."""
    return f"""lg AS (SELECT * FROM {log} l),
  ch AS (SELECT * FROM {chunked('lg')} c),
  lng AS (SELECT * FROM {long_form('ch', label=label)} x),
  flg AS (SELECT * FROM {all_flags('lng', p.contamination_rate, p.threshold, own)} f),
  met AS (SELECT * FROM {metrics('flg')} m),
  bst AS (SELECT * FROM {best('met')} b),
  flagged AS (SELECT DISTINCT f.chunk_id, f.row_id FROM flg f JOIN bst b USING (chunk_id, "column", method) WHERE f.is_outlier),
  normal AS (SELECT * FROM lg WHERE row_id NOT IN (SELECT row_id FROM flagged)),
  mis AS (SELECT * FROM lg WHERE row_id IN (SELECT row_id FROM flagged))"""


def vote_ctes(p, vote_on: str = "outlier") -> str:
    """WITH-list continuing ``consensus_ctes``: vch, vlng, vflg, votes, ranked."""
    hit = "is_outlier" if vote_on == "outlier" else "NOT is_outlier"
    return f"""vch AS (SELECT * FROM {chunked('mis', 1.0)} v),
  vlng AS (SELECT * FROM {long_form('vch', ('value', 'k'), ())} v),
  vflg AS (SELECT * FROM {all_flags('vlng', p.contamination_rate, p.threshold)} v),
  vm AS (SELECT row_id, method, max(CAST({hit} AS INTEGER)) AS h FROM vflg GROUP BY ALL),
  votes AS (SELECT m.row_id, COALESCE(CAST(sum(v.h) AS BIGINT), 0) AS votes
              FROM mis m LEFT JOIN vm v USING (row_id) GROUP BY m.row_id),
  ranked AS (SELECT *, row_number() OVER (ORDER BY votes DESC, row_id) - 1 AS _rank,
                    count(*) OVER () AS _rows,
                    greatest(1, CAST(round_even(count(*) OVER () * {d(p.intentional_perc)}, 0) AS BIGINT)) AS _n
               FROM votes),
  marks AS (SELECT row_id, votes, CASE WHEN _n IN (0, _rows) THEN 0 WHEN _rank < _n THEN 1 ELSE 0 END AS Is_Intentional FROM ranked)"""


def sequential(p, columns) -> str:
    """The columns one after another; rows flagged on a column are gone from the next ones."""
    ctes = [f"lg AS (SELECT * FROM {LOG_SQL} l)", f"ch AS (SELECT * FROM {chunked('lg')} c)", f"lng AS (SELECT * FROM {long_form('ch')} x)"]
    for i, c in enumerate(columns):
        left = f"AND row_id NOT IN (SELECT row_id FROM gone{i - 1})" if i else ""
        ctes += [
            f"lng{i} AS (SELECT * FROM lng WHERE \"column\" = '{c}' {left})",
            f"flg{i} AS (SELECT * FROM {all_flags(f'lng{i}', p.contamination_rate, p.threshold)} f)",
            f"met{i} AS (SELECT * FROM {metrics(f'flg{i}')} m)",
            f"bst{i} AS (SELECT * FROM {best(f'met{i}')} b)",
            f"gone{i} AS (SELECT row_id FROM flg{i} JOIN bst{i} USING (chunk_id, \"column\", method) WHERE is_outlier"
            + (f" UNION SELECT row_id FROM gone{i - 1})" if i else ")")]
    rows = " UNION ALL ".join(f"SELECT chunk_id, \"column\", method, outliers_removed, original_size FROM bst{i}" for i in range(len(columns)))
    return "WITH " + ",\n  ".join(ctes) + "\n" + rows
