"""SQL counterparts of the named queries."""

from __future__ import annotations

from pairsignal import fixtures as fx
from pairsignal.operators import compare, embed, filters, quality, score
from pairsignal.queries import DESIGN_SFREQ, LABEL_BATCH, MANY_NEIGHBOURS, NEIGHBOURS, SMOOTH, SYNC_LAG, SYNC_WINDOW, TAPS, TRIM, WINDOW

ORACLE: dict[str, str] = {}

CHANNELS = "[" + ", ".join(f"'{c}'" for c in fx.EVENT_CHANNELS) + "]"
WIDTH = len(fx.EVENT_CHANNELS)
SECONDS = f"((epoch_us(ts) - epoch_us(TIMESTAMP '{fx.EPOCH}')) / CAST(1e6 AS DOUBLE))"
BIN = f"CAST(floor({SECONDS} / {fx.BIN_SECONDS}) AS BIGINT)"
SFREQ = f"(CAST(1 AS DOUBLE) / {fx.BIN_SECONDS})"


WRITTEN = {"dense", "mask", "islands"}  # read several times


def _ctes(**parts: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS {'MATERIALIZED ' if name in WRITTEN else ''}({body})" for name, body in parts.items())


# Derived recordings, as common table expressions.

USERS = "SELECT DISTINCT user_id FROM events"
DYADS = """
  SELECT CAST(k AS VARCHAR) AS dyad_id, 'spk' || (2 * k) || '-lst' || (2 * k + 1) AS pairing,
         CAST(2 * k AS VARCHAR) AS rec_a, CAST(2 * k + 1 AS VARCHAR) AS rec_b
  FROM (SELECT user_id // 2 AS k FROM users GROUP BY 1 HAVING count(*) = 2)"""
SIDES = """
  SELECT dyad_id, pairing, 'a' AS side, rec_a AS rec_id, 'speaker' AS role FROM dyads
  UNION ALL SELECT dyad_id, pairing, 'b', rec_b, 'listener' FROM dyads"""
RAGGED = f"""
  SELECT CAST(user_id AS VARCHAR) AS rec_id, event_type AS ch,
         CAST(list_position({CHANNELS}, event_type) - 1 AS INTEGER) AS ch_idx,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS t, value AS x
  FROM events"""
RAGGED_LENGTHS = "SELECT rec_id, max(t) + 1 AS n_samples FROM ragged GROUP BY 1"
SUMS = f"""
  SELECT user_id, {BIN} AS t, CAST(list_position({CHANNELS}, event_type) - 1 AS INTEGER) AS ch_idx, sum(value) AS v
  FROM events GROUP BY ALL"""
DENSE = f"""
  SELECT CAST(u.user_id AS VARCHAR) AS rec_id, CAST(b.t AS BIGINT) AS t, CAST(c.ch_idx AS INTEGER) AS ch_idx, coalesce(s.v, 0.0) AS x
  FROM users u CROSS JOIN (SELECT unnest(range({fx.BINS})) AS t) b CROSS JOIN (SELECT unnest(range({WIDTH})) AS ch_idx) c
  LEFT JOIN sums s ON s.user_id = u.user_id AND s.t = b.t AND s.ch_idx = c.ch_idx"""
ANNOTATIONS = f"""
  SELECT CAST(user_id AS VARCHAR) AS rec_id, {SECONDS} AS onset_s, value * 600 AS duration_s FROM events WHERE event_type = 'error'"""
RANGES = f"""
  SELECT rec_id, s, e FROM (
    SELECT rec_id, greatest(CAST(trunc(onset_s * {SFREQ}) AS BIGINT), 0) AS s,
           CAST(trunc((onset_s + duration_s) * {SFREQ}) AS BIGINT) AS e FROM annotations) WHERE e > s"""
HITS = "SELECT DISTINCT d.rec_id, d.t FROM (SELECT DISTINCT rec_id, t FROM dense) d JOIN ranges r ON r.rec_id = d.rec_id AND d.t >= r.s AND d.t < r.e"
ZEROED = """
  SELECT d.rec_id, d.t, d.ch_idx, CASE WHEN h.t IS NULL THEN d.x ELSE 0.0 END AS x
  FROM dense d LEFT JOIN hits h ON h.rec_id = d.rec_id AND h.t = d.t"""


def _mask(source: str) -> str:
    return f"""
  SELECT dyad_id, t, bool_or(zero) AS cut FROM (
    SELECT s.dyad_id, s.side, d.t, bool_and(d.x = 0) AS zero FROM {source} d JOIN sides s ON s.rec_id = d.rec_id GROUP BY ALL)
  GROUP BY ALL"""


EDGES = """
  SELECT dyad_id, t, cut, CASE WHEN cut IS DISTINCT FROM lag(cut) OVER (PARTITION BY dyad_id ORDER BY t) THEN 1 ELSE 0 END AS fresh FROM mask"""
ISLANDS = """
  SELECT dyad_id, cut, min(t) AS start_t, max(t) + 1 AS end_t FROM (
    SELECT dyad_id, t, cut, sum(fresh) OVER (PARTITION BY dyad_id ORDER BY t) AS g FROM edges) GROUP BY dyad_id, cut, g"""
SPANS = f"""
  SELECT dyad_id, CASE WHEN cut THEN 'cut' ELSE 'keep' END AS kind, start_t, end_t,
         round(start_t / {SFREQ}, 6) AS onset_src,
         round((start_t - coalesce(sum(CASE WHEN cut THEN end_t - start_t ELSE 0 END) OVER (
           PARTITION BY dyad_id ORDER BY start_t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / {SFREQ}, 6) AS onset_dst,
         round((end_t - start_t) / {SFREQ}, 6) AS duration_s
  FROM islands"""
KEPT = """
  SELECT dyad_id, t, row_number() OVER (PARTITION BY dyad_id ORDER BY t) - 1 AS t_new FROM mask WHERE NOT cut"""

BASE = {"users": USERS, "dyads": DYADS, "sides": SIDES}
G = {**BASE, "sums": SUMS, "dense": DENSE}
S = {**BASE, "ragged": RAGGED, "lengths": RAGGED_LENGTHS}
ALIGNED = {
    **G, "annotations": ANNOTATIONS, "ranges": RANGES, "hits": HITS, "zeroed": ZEROED, "mask": _mask("zeroed"),
    "edges": EDGES, "islands": ISLANDS, "spans": SPANS, "kept": KEPT,
}
BLANKS = {**G, "mask": _mask("dense"), "edges": EDGES, "islands": ISLANDS}
SHORT = """
  SELECT s.dyad_id, min(l.n_samples) AS n_short FROM sides s JOIN lengths l ON l.rec_id = s.rec_id GROUP BY 1"""
CUT_LONG = """
  SELECT s.dyad_id, s.side, r.rec_id, r.ch, r.ch_idx, r.t, r.x
  FROM ragged r JOIN sides s ON s.rec_id = r.rec_id JOIN short h ON h.dyad_id = s.dyad_id WHERE r.t < h.n_short"""
STACKED_LONG = f"""
  SELECT dyad_id, side, ch, CAST(ch_idx + CASE WHEN side = 'b' THEN {WIDTH} ELSE 0 END AS INTEGER) AS gch_idx, t, x FROM cut_long"""
STACK = {**S, "short": SHORT, "cut_long": CUT_LONG, "stacked": STACKED_LONG}
STACKED_DENSE = f"""
  SELECT s.dyad_id, s.pairing, d.t, CAST(d.ch_idx + CASE WHEN s.side = 'b' THEN {WIDTH} ELSE 0 END AS INTEGER) AS gch_idx, s.role,
         CASE WHEN s.role = 'speaker' THEN 1 ELSE 0 END AS y, d.x
  FROM dense d JOIN sides s ON s.rec_id = d.rec_id"""
LABELLED = {**G, "stacked": STACKED_DENSE}

NAMES = """
  SELECT p_brand AS rec_id, p_partkey AS ch_key,
         CASE WHEN p_partkey % 50 = 0 THEN 'eeg VREF' WHEN p_partkey % 7 = 0 THEN p_name ELSE 'EEG ' || p_size END AS old FROM part"""
RENAMED = """
  SELECT rec_id, ch_key, old,
         CASE WHEN upper(old) = 'EEG VREF' THEN 'Cz'
              WHEN starts_with(old, 'EEG ') AND TRY_CAST(split_part(old, ' ', 2) AS BIGINT) IS NOT NULL
                THEN 'E' || TRY_CAST(split_part(old, ' ', 2) AS BIGINT)
              ELSE old END AS ch,
         upper(old) <> 'EEG VREF' AND starts_with(old, 'EEG ') AND TRY_CAST(split_part(old, ' ', 2) AS BIGINT) IS NULL AS skipped
  FROM names"""

CROWD_SUMS = f"SELECT user_id, {BIN} AS t, sum(value) AS v FROM events GROUP BY ALL"
CROWD = f"""
  SELECT CAST(user_id // {fx.GROUP} AS VARCHAR) AS rec_id, t, CAST(user_id % {fx.GROUP} AS INTEGER) AS ch_idx,
         CASE WHEN user_id % 30 = 0 AND t = 7 THEN 'NaN'::DOUBLE
              WHEN user_id % 30 = 1 THEN 0.0
              WHEN user_id % 30 = 2 THEN v * 50
              WHEN user_id % 30 = 3 AND t % 2 = 1 THEN -v
              ELSE v END AS x
  FROM (SELECT u.user_id, CAST(b.t AS BIGINT) AS t, coalesce(s.v, 0.0) AS v
        FROM users u CROSS JOIN (SELECT unnest(range({fx.BINS})) AS t) b LEFT JOIN crowd_sums s ON s.user_id = u.user_id AND s.t = b.t)"""
BAD_NAN = "SELECT rec_id, ch_idx FROM crowd GROUP BY ALL HAVING bool_or(isnan(x))"
SPREAD = """
  SELECT c.rec_id, c.ch_idx, stddev_pop(x) AS sd, quantile_cont(abs(x - m.med), 0.5) AS mad
  FROM crowd c JOIN (SELECT rec_id, ch_idx, quantile_cont(x, 0.5) AS med FROM crowd WHERE NOT isnan(x) GROUP BY ALL) m
    ON m.rec_id = c.rec_id AND m.ch_idx = c.ch_idx WHERE NOT isnan(x) GROUP BY ALL"""
BAD_FLAT = f"SELECT rec_id, ch_idx FROM spread WHERE sd < {quality.FLAT} OR mad < {quality.FLAT}"
USABLE = """
  SELECT * FROM crowd c WHERE NOT EXISTS (SELECT 1 FROM bad_nan b WHERE b.rec_id = c.rec_id AND b.ch_idx = c.ch_idx)
    AND NOT EXISTS (SELECT 1 FROM bad_flat b WHERE b.rec_id = c.rec_id AND b.ch_idx = c.ch_idx)"""
M = {"users": USERS, "crowd_sums": CROWD_SUMS, "crowd": CROWD, "bad_nan": BAD_NAN, "spread": SPREAD, "bad_flat": BAD_FLAT, "usable": USABLE}


def _robust(value: str, source: str) -> str:
    return f"""
  SELECT a.rec_id, a.ch_idx, a.{value},
         CASE WHEN q.q3 = q.q1 THEN NULL ELSE (a.{value} - q.q2) / ({quality.IQR_TO_SD} * (q.q3 - q.q1)) END AS z
  FROM {source} a JOIN (
    SELECT rec_id, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS q2, quantile_cont({value}, 0.75) AS q3
    FROM {source} GROUP BY 1) q ON q.rec_id = a.rec_id"""


AMPS = f"""
  SELECT rec_id, ch_idx, {quality.IQR_TO_SD} * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS amp FROM usable GROUP BY ALL"""


def _fir(source: str, taps: list[float]) -> str:
    """Weighted neighbours; beyond the ends the signal is point-mirrored."""
    h = len(taps) // 2
    terms = []
    for k, w in enumerate(taps):
        d = h - k
        near = f"lag(x, {d}) OVER w" if d > 0 else (f"lead(x, {-d}) OVER w" if d < 0 else "x")
        if d > 0:
            near = f"CASE WHEN t >= {d} THEN {near} ELSE 2 * first_x - lead(x, CAST({d} - 2 * t AS INTEGER)) OVER w END"
        elif d < 0:
            near = f"CASE WHEN t + {-d} < {fx.BINS} THEN {near} ELSE 2 * last_x - lag(x, CAST({-d} - 2 * ({fx.BINS} - 1 - t) AS INTEGER)) OVER w END"
        terms.append(f"CAST({w!r} AS DOUBLE) * ({near})")
    return f"""
  SELECT rec_id, ch_idx, t, x, {" + ".join(terms)} AS y
  FROM (SELECT *, first_value(x) OVER w2 AS first_x, last_value(x) OVER w2 AS last_x FROM {source}
        WINDOW w2 AS (PARTITION BY rec_id, ch_idx ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
  WINDOW w AS (PARTITION BY rec_id, ch_idx ORDER BY t)"""


def _mad(value: str, source: str) -> str:
    return f"""
  SELECT s.rec_id, s.ch_idx, quantile_cont(abs({value} - m.med), 0.5) AS mad FROM {source} s JOIN (
    SELECT rec_id, ch_idx, quantile_cont({value}, 0.5) AS med FROM {source} GROUP BY ALL) m
    ON m.rec_id = s.rec_id AND m.ch_idx = s.ch_idx GROUP BY ALL"""


NOISE = """
  SELECT h.rec_id, h.ch_idx, CASE WHEN l.mad = 0 THEN NULL ELSE h.mad / l.mad END AS noise
  FROM high h JOIN low l ON l.rec_id = h.rec_id AND l.ch_idx = h.ch_idx"""
MOMENTS = f"""
  SELECT rec_id, ch_idx, t // {int(WINDOW)} AS win, t, x - avg(x) OVER p AS c, sqrt(sum(x * x) OVER p) AS raw
  FROM usable WINDOW p AS (PARTITION BY rec_id, ch_idx, t // {int(WINDOW)})"""
LENGTHS_WIN = "SELECT rec_id, ch_idx, win, sqrt(sum(c * c)) AS len, max(raw) AS raw FROM moments GROUP BY ALL"
PAIRS_WIN = """
  SELECT a.rec_id, a.win, a.ch_idx, b.ch_idx AS other, abs(sum(a.c * b.c)) AS dot
  FROM moments a JOIN moments b ON a.rec_id = b.rec_id AND a.t = b.t AND a.ch_idx <> b.ch_idx GROUP BY ALL"""
CORR_WIN = f"""
  SELECT p.rec_id, p.win, p.ch_idx,
         quantile_cont(CASE WHEN la.len > 1e-12 * la.raw AND lb.len > 1e-12 * lb.raw THEN p.dot / (la.len * lb.len) ELSE 0 END, {quality.CORR_QUANTILE}) AS corr
  FROM pairs p JOIN lens la ON la.rec_id = p.rec_id AND la.win = p.win AND la.ch_idx = p.ch_idx
       JOIN lens lb ON lb.rec_id = p.rec_id AND lb.win = p.win AND lb.ch_idx = p.other GROUP BY ALL"""
CORR = {**M, "moments": MOMENTS, "lens": LENGTHS_WIN, "pairs": PAIRS_WIN, "corrs": CORR_WIN}

VECTORS = f"""
  SELECT vec_id AS t, CAST(embedding AS DOUBLE[]) AS e, label,
         CASE WHEN vec_id % {fx.TRAIN_MODULUS} = {fx.TRAIN_MODULUS - 1} THEN 'test' ELSE 'train' END AS split FROM embeddings"""
RUNS = f"""
  SELECT vec_id AS t, r AS run_id, CAST(embedding[3 * r + 1] AS DOUBLE) AS e1,
         CAST(embedding[(3 * r + 1) % {fx.DIMS} + 1] AS DOUBLE) AS e2, CAST(embedding[(3 * r + 2) % {fx.DIMS} + 1] AS DOUBLE) AS e3
  FROM embeddings CROSS JOIN (SELECT CAST(unnest(range({fx.RUNS})) AS INTEGER) AS r)"""
RANKED = """
  SELECT q.t AS qid, c.t AS nid, c.label, round(list_cosine_similarity(q.e, c.e), 10) AS sim,
         row_number() OVER (PARTITION BY q.t ORDER BY round(list_cosine_similarity(q.e, c.e), 10) DESC, c.t) AS rank
  FROM (SELECT * FROM vectors WHERE split = 'test') q CROSS JOIN (SELECT * FROM vectors WHERE split = 'train') c"""
NEAREST = f"SELECT * FROM ranked WHERE rank <= {NEIGHBOURS}"
VOTES = """
  SELECT qid, label AS pred, votes FROM (
    SELECT qid, label, count(*) AS votes, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, label) AS r FROM nearest GROUP BY qid, label)
  WHERE r = 1"""
E = {"vectors": VECTORS}
KNN = {**E, "ranked": RANKED, "nearest": NEAREST, "votes": VOTES}
DECODED = "SELECT v.label, p.pred FROM votes p JOIN vectors v ON v.t = p.qid"


def _fits(pairs: str) -> dict[str, str]:
    """R2 of the linear map between two 3-D runs, out of moments: explained variance is s' inv(Sxx) s per output."""
    m = ["a1", "a2", "a3"]
    cov = ", ".join(f"covar_pop({p}, {q}) AS s{i}{j}" for i, p in enumerate(m, 1) for j, q in enumerate(m, 1) if i <= j)
    cross = ", ".join(f"covar_pop({p}, b{k}) AS c{i}{k}" for i, p in enumerate(m, 1) for k in (1, 2, 3))
    own = ", ".join(f"var_pop(b{k}) AS v{k}" for k in (1, 2, 3))
    det = "(s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s23 * s13) + s13 * (s12 * s23 - s22 * s13))"
    inverse = {
        (1, 1): "s22 * s33 - s23 * s23", (1, 2): "s13 * s23 - s12 * s33", (1, 3): "s12 * s23 - s13 * s22",
        (2, 2): "s11 * s33 - s13 * s13", (2, 3): "s12 * s13 - s11 * s23", (3, 3): "s11 * s22 - s12 * s12",
    }

    def explained(k: int) -> str:
        return " + ".join(f"c{i}{k} * c{j}{k} * ({inverse[min(i, j), max(i, j)]})" for i in (1, 2, 3) for j in (1, 2, 3))

    x = ", ".join(f"({explained(k)}) / {det} AS x{k}" for k in (1, 2, 3))
    return {
        "run_pairs": pairs,
        "moms": f"SELECT pairing, run_i, run_j, count(*) AS n, {cov}, {cross}, {own} FROM run_pairs GROUP BY ALL",
        "expl": f"SELECT *, {x} FROM moms",
        "fits": "SELECT pairing, run_i, run_j, n, (x1 / v1 + x2 / v2 + x3 / v3) / 3 AS r2, (x1 + x2 + x3) / (v1 + v2 + v3) AS r2_weighted FROM expl",
    }


RUN_FITS = {"runs": RUNS, **_fits("""
  SELECT 'all' AS pairing, a.run_id AS run_i, b.run_id AS run_j, a.e1 AS a1, a.e2 AS a2, a.e3 AS a3, b.e1 AS b1, b.e2 AS b2, b.e3 AS b3
  FROM runs a JOIN runs b ON a.t = b.t AND a.run_id <> b.run_id""")}
SIDE_ROWS = """
  SELECT s.pairing, CASE WHEN s.side = 'b' THEN 2 ELSE 0 END + p.part AS run_id, d.t, max(CASE WHEN ch_idx = 2 * p.part THEN x END) AS e1,
         max(CASE WHEN ch_idx = 2 * p.part + 1 THEN x END) AS e2, max(CASE WHEN ch_idx = 2 * p.part + 2 THEN x END) AS e3
  FROM dense d JOIN sides s ON s.rec_id = d.rec_id CROSS JOIN (SELECT unnest([0, 1]) AS part) p GROUP BY ALL"""
SIDE_FITS = {**G, "runs": SIDE_ROWS, **_fits("""
  SELECT a.pairing, a.run_id AS run_i, b.run_id AS run_j, a.e1 AS a1, a.e2 AS a2, a.e3 AS a3, b.e1 AS b1, b.e2 AS b2, b.e3 AS b3
  FROM runs a JOIN runs b ON a.pairing = b.pairing AND a.t = b.t AND a.run_id <> b.run_id""")}
MEANS = "SELECT pairing, avg(r2) AS mean_consistency, 1 - avg(r2) AS variability FROM fits GROUP BY 1"

STATUS = {
    "ragged": RAGGED,
    "counts": "SELECT rec_id AS pairing, ch_idx AS run_id, count(*) AS n, avg(x) AS acc_val, max(t) AS n_val FROM ragged GROUP BY ALL",
    "expected": f"SELECT pairing, CAST(r AS INTEGER) AS run_id FROM (SELECT DISTINCT rec_id AS pairing FROM ragged) CROSS JOIN (SELECT unnest(range({WIDTH})) AS r)",
    "good": "SELECT * FROM counts WHERE n >= 10",
}
CELLS = f"""
  SELECT c.clean, z.scaling, d.pairing, d.rec_a, d.rec_b FROM dyads d
  CROSS JOIN (SELECT unnest({CHANNELS}) AS clean) c CROSS JOIN (SELECT unnest(['raw', 'normalized']) AS scaling) z"""
LISTED = """
  SELECT CAST(user_id AS VARCHAR) AS rec_id, (a % 4) || ', ' || (b % 4) || ',x,-3, 0' || a AS listed, a, b FROM (
    SELECT user_id, count(*) FILTER (event_type = 'error') AS a, count(*) FILTER (event_type = 'view') AS b FROM events GROUP BY 1)"""


def _add(name: str, ctes: dict[str, str], select: str) -> None:
    ORACLE[name] = (_ctes(**ctes) + "\n" if ctes else "") + select


_add("rename_channels", {"names": NAMES, "renamed": RENAMED}, "SELECT rec_id, ch_key, old, ch, skipped FROM renamed")
_add("duplicate_channels", {"names": NAMES, "renamed": RENAMED},
     "SELECT rec_id, ch, count(*) AS n FROM renamed GROUP BY ALL HAVING count(*) > 1")
_add("pick_channels", G, """
SELECT rec_id, t, CAST(CASE WHEN ch_idx > 1 THEN ch_idx - 1 ELSE ch_idx END AS INTEGER) AS ch_idx, x FROM dense WHERE ch_idx <> 1""")
_add("recording_shapes", G, f"""
SELECT rec_id, max(t) + 1 AS n_samples, CAST(count(DISTINCT ch_idx) AS INTEGER) AS n_channels,
       round(CAST((max(t) + 1) * {fx.BIN_SECONDS} AS DOUBLE), 6) AS seconds FROM dense GROUP BY 1""")
_add("align_lengths", STACK, "SELECT dyad_id, side, rec_id, ch, t, x FROM cut_long")
_add("stack_channels", STACK, "SELECT dyad_id, side, ch, gch_idx, t, x FROM stacked")
_add("minmax_per_channel", STACK, """
SELECT dyad_id, gch_idx, t, round((x - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS x FROM (
  SELECT dyad_id, gch_idx, t, x, min(x) OVER w AS lo, max(x) OVER w AS hi FROM stacked WINDOW w AS (PARTITION BY dyad_id, gch_idx))""")
_add("prepare_grid", {**LABELLED, "cells": f"""
  SELECT 'zeropad_30' AS clean, pairing, t, gch_idx, x FROM stacked
  UNION ALL SELECT 'cut_60', pairing, t - {(fx.BINS - TRIM) // 2}, gch_idx, x FROM stacked
  WHERE t >= {(fx.BINS - TRIM) // 2} AND t < {(fx.BINS - TRIM) // 2 + TRIM}"""}, """
SELECT clean, 'raw' AS scaling, pairing, t, gch_idx, round(x, 6) AS x FROM cells
UNION ALL
SELECT clean, 'normalized', pairing, t, gch_idx, round((x - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) FROM (
  SELECT *, min(x) OVER w AS lo, max(x) OVER w AS hi FROM cells WINDOW w AS (PARTITION BY clean, pairing, gch_idx))""")
_add("stack_in_time", G, f"""
SELECT s.dyad_id AS rec_id, d.t + CASE WHEN s.side = 'b' THEN {fx.BINS} ELSE 0 END AS t, d.ch_idx, d.x
FROM dense d JOIN sides s ON s.rec_id = d.rec_id""")
_add("orient_wide", G, "SELECT rec_id, t, " + ", ".join(f"max(CASE WHEN ch_idx = {i} THEN x END) AS x{i}" for i in range(WIDTH)) + " FROM dense GROUP BY rec_id, t")
_add("flatten_long", G, f"SELECT rec_id, t * {WIDTH} + ch_idx AS row, x FROM dense")
_add("middle_trim", G, f"""
SELECT rec_id, t - {(fx.BINS - TRIM) // 2} AS t, ch_idx, x FROM dense
WHERE t >= {(fx.BINS - TRIM) // 2} AND t < {(fx.BINS - TRIM) // 2 + TRIM}""")
_add("half_precision", {}, """
SELECT t, dim, CASE WHEN v = 0 THEN v ELSE round_even(v / step, 0) * step END AS h FROM (
  SELECT t, dim, v, pow(CAST(2 AS DOUBLE), greatest(floor(log2(abs(CASE WHEN v = 0 THEN 1 ELSE v END))), -14) - 10) AS step FROM (
    SELECT vec_id AS t, CAST(i - 1 AS INTEGER) AS dim, CAST(embedding[i] AS DOUBLE) AS v
    FROM embeddings CROSS JOIN (SELECT unnest(range(1, 65)) AS i)))""")
_add("temporal_split", S, """
SELECT r.rec_id, r.ch, r.t, CASE WHEN r.t < CAST(floor(CAST(0.8 AS DOUBLE) * l.n_samples) AS BIGINT) THEN 'train' ELSE 'test' END AS split
FROM ragged r JOIN lengths l ON l.rec_id = r.rec_id""")
_add("split_counts", S, """
SELECT r.rec_id, count(*) FILTER (r.t < CAST(floor(CAST(0.8 AS DOUBLE) * l.n_samples) AS BIGINT)) AS n_train,
       count(*) FILTER (r.t >= CAST(floor(CAST(0.8 AS DOUBLE) * l.n_samples) AS BIGINT)) AS n_val
FROM ragged r JOIN lengths l ON l.rec_id = r.rec_id GROUP BY 1""")
_add("segment_sixths", S, """
SELECT rec_id, ch, t, CAST(t // six AS INTEGER) AS part FROM (
  SELECT r.rec_id, r.ch, r.t, CAST(floor(CAST(0.8 AS DOUBLE) * l.n_samples) AS BIGINT) // 6 AS six
  FROM ragged r JOIN lengths l ON l.rec_id = r.rec_id)
WHERE six > 0 AND t // CASE WHEN six > 0 THEN six ELSE 1 END IN (1, 3)""")
_add("pick_times", G, """
SELECT rec_id, t, ch_idx, x FROM (
  SELECT *, lag(cut) OVER (PARTITION BY rec_id, ch_idx ORDER BY t) AS before FROM (
    SELECT *, bool_or(zero) OVER (PARTITION BY dyad_id, t) AS cut FROM (
      SELECT s.dyad_id, d.rec_id, d.t, d.ch_idx, d.x, bool_and(d.x = 0) OVER (PARTITION BY d.rec_id, d.t) AS zero
      FROM dense d JOIN sides s ON s.rec_id = d.rec_id)))
WHERE NOT cut AND coalesce(before, true)""")
_add("role_labels", LABELLED, "SELECT dyad_id, t, gch_idx, x, role, y FROM stacked")
_add("distinct_labels", LABELLED, "SELECT DISTINCT dyad_id, y FROM stacked")
_add("repeat_tile", LABELLED, """
SELECT e.dyad_id, e.t, e.e0, c.gch_idx, c.role, c.y FROM (SELECT dyad_id, t, round(sum(x), 6) AS e0 FROM stacked GROUP BY ALL) e
JOIN (SELECT DISTINCT dyad_id, gch_idx, role, y FROM stacked) c ON c.dyad_id = e.dyad_id""")
_add("annotation_ranges", {"annotations": ANNOTATIONS, "ranges": RANGES}, """
SELECT rec_id, t, CAST(sum(delta) AS BIGINT) AS delta FROM (
  SELECT rec_id, s AS t, 1 AS delta FROM ranges UNION ALL SELECT rec_id, e, -1 FROM ranges) GROUP BY ALL""")
_add("pad_and_zero_annotations", {
    **{k: ALIGNED[k] for k in ("users", "dyads", "sides", "sums", "dense", "annotations", "ranges", "hits", "zeroed")},
    "active": f"SELECT CAST(user_id AS VARCHAR) AS rec_id, max({BIN}) + 1 AS n_samples FROM events GROUP BY 1",
    "longest": "SELECT s.dyad_id, max(a.n_samples) AS n FROM sides s JOIN active a ON a.rec_id = s.rec_id GROUP BY 1",
}, """
SELECT s.dyad_id, s.side, z.t, z.ch_idx, CASE WHEN z.t < a.n_samples THEN z.x ELSE 0.0 END AS x
FROM zeroed z JOIN sides s ON s.rec_id = z.rec_id JOIN active a ON a.rec_id = z.rec_id JOIN longest l ON l.dyad_id = s.dyad_id
WHERE z.t < l.n""")
_add("blank_mask", ALIGNED, "SELECT dyad_id, t, cut FROM mask")
_add("run_edges", BLANKS, """
SELECT dyad_id, start_t AS t, 1 AS edge FROM islands WHERE cut UNION ALL SELECT dyad_id, end_t, -1 FROM islands WHERE cut""")
_add("cut_segments", ALIGNED, "SELECT * FROM spans WHERE kind = 'cut'")
_add("keep_segments", ALIGNED, "SELECT * FROM spans WHERE kind = 'keep'")
_add("shared_annotations", ALIGNED, """
SELECT s.rec_id, s.dyad_id, p.onset_src AS onset_s, p.onset_dst, p.duration_s, 'cut' AS description
FROM spans p JOIN sides s ON s.dyad_id = p.dyad_id WHERE p.kind = 'cut'""")
_add("mutual_align", ALIGNED, """
SELECT s.dyad_id, s.rec_id, s.side, k.t_new AS t, d.ch_idx, d.x
FROM dense d JOIN sides s ON s.rec_id = d.rec_id JOIN kept k ON k.dyad_id = s.dyad_id AND k.t = d.t""")
_add("aligned_inputs", {**ALIGNED, "stacked": STACKED_DENSE}, """
SELECT dyad_id, t, gch_idx, round((x - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS x FROM (
  SELECT s.dyad_id, k.t_new AS t, s.gch_idx, s.x, min(s.x) OVER w AS lo, max(s.x) OVER w AS hi
  FROM stacked s JOIN kept k ON k.dyad_id = s.dyad_id AND k.t = s.t WINDOW w AS (PARTITION BY s.dyad_id, s.gch_idx))""")
PRESENT = "SELECT CAST(user_id AS VARCHAR) AS rec_id, event_type AS clean FROM events GROUP BY ALL HAVING count(*) >= 10"
_add("missing_inputs", {"users": USERS, "dyads": DYADS, "cells": CELLS, "present": PRESENT}, """
SELECT clean, scaling, pairing FROM cells c WHERE NOT (
  EXISTS (SELECT 1 FROM present p WHERE p.clean = c.clean AND p.rec_id = c.rec_a)
  AND EXISTS (SELECT 1 FROM present p WHERE p.clean = c.clean AND p.rec_id = c.rec_b))""")
_add("skip_tags", {"users": USERS, "dyads": DYADS, "cells": CELLS}, """
SELECT clean, scaling, pairing FROM cells WHERE NOT (scaling = 'normalized' AND rec_a IN (
  SELECT CAST(user_id AS VARCHAR) FROM events GROUP BY user_id HAVING count(*) < 60))""")
_add("pairing_parse", {"users": USERS, "dyads": DYADS}, """
SELECT pairing, 'speaker' AS role_a, CAST(rec_a AS BIGINT) AS subject_a, 'listener' AS role_b, CAST(rec_b AS BIGINT) AS subject_b FROM dyads""")
_add("file_names", {}, """
SELECT page_id, base, regexp_replace(base, '^(.+)\\.[^.]*$', '\\1') AS stem, regexp_replace(base, '^(.+)\\.[^.]*$', '\\1') || '_preprocessed' AS cleaned
FROM (SELECT page_id, regexp_extract(url, '([^/\\\\]*)$', 1) AS base FROM pages)""")
_add("fir_highpass", {**G, "filtered": _fir("dense", TAPS)}, "SELECT rec_id, t, ch_idx, round(y, 6) AS x FROM filtered")
_add("highpass_designed", {**G, "filtered": _fir("dense", filters.design(DESIGN_SFREQ, filters.HIGHPASS_HZ, None).tolist())},
     "SELECT rec_id, t, ch_idx, round(y, 6) AS x FROM filtered")
_add("bad_nan", M, "SELECT rec_id, ch_idx, 'nan' AS criterion FROM bad_nan")
_add("bad_flat", M, "SELECT rec_id, ch_idx, 'flat' AS criterion FROM bad_flat")
_add("channel_spread", M, "SELECT rec_id, ch_idx, round(sd, 6) AS sd, round(mad, 6) AS mad FROM spread")
_add("bad_deviation", {**M, "amps": AMPS, "scored": _robust("amp", "amps")},
     f"SELECT rec_id, ch_idx, round(amp, 9) AS amp, round(z, 6) AS z, abs(z) > {quality.Z_LIMIT} AS bad FROM scored")
_add("bad_hf_noise", {
    **M, "filtered": _fir("usable", SMOOTH), "low": _mad("y", "filtered"),
    "rest": "SELECT rec_id, ch_idx, t, x - y AS y FROM filtered", "high": _mad("y", "rest"), "noises": NOISE, "scored": _robust("noise", "noises"),
}, f"SELECT rec_id, ch_idx, round(noise, 6) AS noise, round(z, 6) AS z, z > {quality.Z_LIMIT} AS bad FROM scored")
_add("window_correlation", CORR, "SELECT rec_id, win, ch_idx, round(corr, 6) AS corr FROM corrs")
_add("bad_correlation", CORR, f"""
SELECT rec_id, ch_idx, round(fraction, 6) AS fraction, fraction > {quality.CORR_FRACTION} AS bad FROM (
  SELECT rec_id, ch_idx, avg(CASE WHEN corr < {quality.CORR_LIMIT} THEN CAST(1 AS DOUBLE) ELSE 0 END) AS fraction FROM corrs GROUP BY ALL)""")
_add("bad_union", {**M, "amps": AMPS, "scored": _robust("amp", "amps"), "bads": f"""
  SELECT rec_id, ch_idx FROM bad_nan UNION SELECT rec_id, ch_idx FROM bad_flat
  UNION SELECT rec_id, ch_idx FROM scored WHERE abs(z) > {quality.Z_LIMIT}"""},
     "SELECT rec_id, count(*) AS n_bad, string_agg(CAST(ch_idx AS VARCHAR), ',' ORDER BY ch_idx) AS channels FROM bads GROUP BY 1")
_add("remix_matrix", G, f"""
SELECT d.rec_id, d.t, CAST(o.i AS INTEGER) AS ch_idx, round(sum(d.x * (CAST(1 AS DOUBLE) / (1 + abs(d.ch_idx - o.i)))), 6) AS x
FROM dense d CROSS JOIN (SELECT unnest(range({WIDTH})) AS i) o GROUP BY ALL""")
_add("receptive_field", {"runs": RUNS, "n": "SELECT max(t) + 1 AS n FROM runs"}, """
SELECT CAST(c.run_id AS VARCHAR) AS rec_id, c.t, CAST(3 * (r.t - c.t + 5) + d.k - 1 AS INTEGER) AS feature,
       round(CASE d.k WHEN 1 THEN r.e1 WHEN 2 THEN r.e2 ELSE r.e3 END, 6) AS x
FROM runs c JOIN runs r ON r.run_id = c.run_id AND r.t BETWEEN c.t - 5 AND c.t + 4
CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) d CROSS JOIN n WHERE c.t >= 5 AND c.t + 4 < n.n""")
_add("positive_pairs", E, """
SELECT a.t, b.t AS t_pos, round(list_cosine_similarity(a.e, b.e), 6) AS sim FROM vectors a JOIN vectors b ON b.t = a.t + 10""")
_add("nearest_label", {**E, "halves": f"""
  SELECT t, list_reduce(e[1:{fx.DIMS // 2}], lambda a, b: a + b) AS y, list_reduce(e[{fx.DIMS // 2 + 1}:{fx.DIMS}], lambda a, b: a + b) AS target
  FROM vectors"""}, """
SELECT t, t_pos, round(target, 6) AS target, round(y_pos, 6) AS y_pos FROM (
  SELECT a.t, a.target, b.t AS t_pos, b.y AS y_pos, row_number() OVER (PARTITION BY a.t ORDER BY abs(a.target - b.y), b.y, b.t) AS r
  FROM halves a CROSS JOIN halves b) WHERE r = 1""")
_add("knn_topk", KNN, "SELECT qid, CAST(rank AS INTEGER) AS rank, nid, round(sim, 6) AS sim FROM nearest")
_add("knn_decode", KNN, "SELECT qid, pred, votes FROM votes")
_add("knn_counted", {**KNN, "nearest": f"SELECT * FROM ranked WHERE rank <= {MANY_NEIGHBOURS}"}, "SELECT qid, pred, votes FROM votes")
_add("knn_sqrt", {**KNN, "nearest": "SELECT * FROM ranked WHERE rank <= (SELECT floor(sqrt(count(*))) FROM vectors WHERE split = 'train')"}, "SELECT qid, pred, votes FROM votes")
_add("decoding_accuracy", {**KNN, "decoded": DECODED},
     "SELECT 'all' AS pairing, count(*) AS n, round(avg(CASE WHEN label = pred THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS accuracy FROM decoded")
_add("decoding_r2", {**KNN, "decoded": DECODED}, """
SELECT 'all' AS pairing, count(*) AS n,
       round(1 - sum(CAST((label - pred) * (label - pred) AS DOUBLE)) / nullif(var_pop(CAST(label AS DOUBLE)) * count(*), 0), 6) AS r2 FROM decoded""")
_add("infonce_bits", {**E,
    "n": f"SELECT CAST(ceil((max(t) + 1) / CAST({score.BATCH} AS DOUBLE)) AS BIGINT) AS b FROM vectors",
    "refs": f"SELECT a.t, a.t % n.b AS batch, a.e, list_cosine_similarity(a.e, p.e) / CAST({score.TEMPERATURE} AS DOUBLE) AS near FROM vectors a JOIN vectors p ON p.t = a.t + 10 CROSS JOIN n",
    "losses": f"""
  SELECT a.t, ln(sum(exp(list_cosine_similarity(a.e, b.e) / CAST({score.TEMPERATURE} AS DOUBLE)))) - a.near AS loss, ln(CAST(count(*) AS DOUBLE)) AS ceiling
  FROM refs a JOIN refs b ON a.batch = b.batch AND a.t <> b.t GROUP BY a.t, a.near"""}, """
SELECT 'all' AS pairing, 0 AS run_id, count(*) AS n, round(avg(loss), 6) AS loss, round(avg((ceiling - loss) / ln(CAST(2 AS DOUBLE))), 6) AS bits FROM losses""")
BITS = f"(ln(CAST({score.BATCH} AS DOUBLE)) - ln(1 + x)) / ln(CAST(2 AS DOUBLE))"
_add("fit_history", {"ragged": RAGGED},
     f"SELECT rec_id AS pairing, ch_idx AS run_id, CAST(t AS INTEGER) AS iter, round({BITS}, 6) AS bits FROM ragged")
_add("history_summary", {"ragged": RAGGED, "h": f"SELECT rec_id AS pairing, ch_idx AS run_id, t, {BITS} AS bits FROM ragged"}, """
SELECT pairing, run_id, count(*) AS n_iter, round(max(bits), 6) AS best_bits, round(max_by(bits, t), 6) AS last_bits FROM h GROUP BY ALL""")
_add("run_consistency", RUN_FITS, "SELECT pairing, run_i, run_j, n, round(r2, 6) AS r2, round(r2_weighted, 6) AS r2_weighted FROM fits")
_add("variability", {**RUN_FITS, "means": MEANS},
     "SELECT pairing, round(mean_consistency, 6) AS mean_consistency, round(variability, 6) AS variability FROM means")
_add("side_variability", {**SIDE_FITS, "means": MEANS},
     "SELECT pairing, round(mean_consistency, 6) AS mean_consistency, round(variability, 6) AS variability FROM means")
_add("result_lines", {**SIDE_FITS, "means": MEANS}, """
SELECT printf('%-40s  consistency=%.4f  variability=%.4f', 'zeropad_30/raw/' || pairing, mean_consistency, variability) AS value FROM means""")
_add("class_distance", E, """
SELECT 'all' AS pairing, round(avg(CASE WHEN a.label = b.label THEN 1 - list_cosine_similarity(a.e, b.e) END), 6) AS intra,
       round(avg(CASE WHEN a.label <> b.label THEN 1 - list_cosine_similarity(a.e, b.e) END), 6) AS inter
FROM vectors a JOIN vectors b ON a.t <> b.t""")
_add("run_status_filter", STATUS, "SELECT pairing, count(*) AS n_runs, CAST(sum(n) AS BIGINT) AS n_rows FROM good GROUP BY 1")
_add("metrics_summary", STATUS, """
SELECT e.pairing, e.run_id, coalesce(round(g.acc_val, 6), -1) AS acc_val, CAST(coalesce(g.n_val, -1) AS DOUBLE) AS n_val, g.pairing IS NULL AS absent
FROM expected e LEFT JOIN good g ON g.pairing = e.pairing AND g.run_id = e.run_id""")
_add("pairing_report", STATUS, """
SELECT e.pairing, count(*) AS n_runs, round(avg(g.acc_val), 6) AS acc_val
FROM expected e LEFT JOIN good g ON g.pairing = e.pairing AND g.run_id = e.run_id GROUP BY 1""")
_add("metrics_json", {"ragged": RAGGED}, """
SELECT rec_id AS pairing, ch_idx AS run_id, count(*) AS n_val, max(CASE WHEN t >= 10 THEN x END) AS late, CAST(NULL AS DOUBLE) AS absent
FROM ragged GROUP BY ALL""")
_add("exclusion_parse", {"listed": LISTED}, "SELECT rec_id, listed, (a % 4) || ',' || (b % 4) || ',' || a AS comps FROM listed")
_add("processing_log", {"users": "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS c FROM events GROUP BY 1"}, """
SELECT 'user' || user_id || '.edf' AS original_file, '2024-01-31T00:00:00' AS ts, 0 AS pos, 'load' AS step,
       'Loaded ' || n || ' events' AS description, CAST(n AS VARCHAR) AS param FROM users
UNION ALL
SELECT 'user' || user_id || '.edf', '2024-01-31T00:00:00', 1, 'select', 'Kept event types', CAST(c AS VARCHAR) FROM users""")

# Labels by difference, labelled goodness of fit

LABELS = "SELECT vec_id AS t, list_sum(list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1000))) AS y FROM embeddings"
_add("nearest_label_pairs", {
    "labels_of": LABELS,
    "changes": f"SELECT a.t AS s, b.y - a.y AS change FROM labels_of a JOIN labels_of b ON b.t = a.t + {embed.OFFSET}",
    "wanted": f"""
  SELECT t, y + change AS target FROM labels_of CROSS JOIN (SELECT max(t) + 1 - {embed.OFFSET} AS m FROM labels_of)
  JOIN changes ON s = ((t % {embed.DRAW_MODULUS}) * {embed.DRAW_FACTOR}) % m"""}, """
SELECT 'all' AS pairing, t, target, t_pos, y_pos FROM (
  SELECT w.t, w.target, l.t AS t_pos, l.y AS y_pos, row_number() OVER (PARTITION BY w.t ORDER BY abs(w.target - l.y), l.y, l.t) AS r
  FROM wanted w CROSS JOIN labels_of l) WHERE r = 1""")


def _labelled(y: str) -> tuple[dict[str, str], str]:
    mixed = f"((vec_id % {score.LABEL_MODULUS}) * {score.LABEL_FACTOR}) % {score.LABEL_MODULUS}"
    return {
        "n": f"SELECT CAST(greatest(floor((max(vec_id) + 1) / CAST({LABEL_BATCH} AS DOUBLE)), 1) AS BIGINT) AS b FROM embeddings",
        "members": f"SELECT vec_id AS t, {mixed} % n.b AS batch, {y} AS y, embedding::DOUBLE[] AS e FROM embeddings CROSS JOIN n",
        "paired": f"""
  SELECT a.t, a.y, b.t AS u, list_cosine_similarity(a.e, b.e) / CAST({score.TEMPERATURE} AS DOUBLE) AS sim,
         row_number() OVER (PARTITION BY a.t ORDER BY abs(a.y - b.y), b.t < a.t, b.t) AS r
  FROM members a JOIN members b ON a.batch = b.batch AND a.t <> b.t""",
        "losses": "SELECT t, ln(sum(exp(sim))) - max(CASE WHEN r = 1 THEN sim END) AS loss, ln(CAST(count(*) AS DOUBLE)) AS ceiling FROM paired GROUP BY t",
    }, """
SELECT 'all' AS pairing, 0 AS run_id, (SELECT count(*) FROM members) AS n, round(avg(loss), 6) AS loss,
       round(avg((ceiling - loss) / ln(CAST(2 AS DOUBLE))), 6) AS bits FROM losses"""


_add("infonce_labelled", *_labelled("list_sum(list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1000)))"))
_add("infonce_classes", *_labelled("label"))

# Synchrony and groups

SYNC = {**G, "lagged": f"""
  SELECT d.dyad_id, a.t // {SYNC_WINDOW} AS win, CAST(l.lag AS INTEGER) AS lag, a.ch_idx, a.x, b.x AS y
  FROM dyads d JOIN dense a ON a.rec_id = d.rec_a CROSS JOIN (SELECT unnest(range(-{SYNC_LAG}, {SYNC_LAG} + 1)) AS lag) l
  LEFT JOIN dense b ON b.rec_id = d.rec_b AND b.ch_idx = a.ch_idx AND b.t = a.t + l.lag""", "synced": """
  SELECT dyad_id, win, lag, ch_idx, count(y) AS n,
         CASE WHEN max(x) FILTER (y IS NOT NULL) > min(x) FILTER (y IS NOT NULL) AND max(y) > min(y) THEN corr(y, x) END AS r
  FROM lagged GROUP BY ALL"""}
_add("window_synchrony", SYNC, "SELECT dyad_id, win, lag, ch_idx, n, round(r, 6) AS r FROM synced")
_add("synchrony_by_leader", SYNC, """
SELECT dyad_id, CASE sign(lag) WHEN 1 THEN 'speaker' WHEN -1 THEN 'listener' ELSE 'none' END AS leader, count(r) AS n, round(avg(r), 6) AS r
FROM synced GROUP BY 1, 2""")
RUN_VALUES = {"ragged": RAGGED, "run_values": """
  SELECT CASE WHEN CAST(rec_id AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END AS grp, rec_id AS pairing, ch_idx AS run_id,
         CAST(sum(CAST(round(x * 100) AS BIGINT)) AS BIGINT) // count(*) AS value FROM ragged GROUP BY ALL"""}
_add("metrics_rollup", RUN_VALUES, """
SELECT grp, pairing, CAST(run_id AS VARCHAR) AS run_id, CAST(3 - (grouping(grp) + grouping(pairing) + grouping(run_id)) AS INTEGER) AS level, count(value) AS n,
       round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM run_values GROUP BY ROLLUP (grp, pairing, run_id)""")
_add("group_comparison", {**RUN_VALUES,
    "units": "SELECT CAST(pairing AS BIGINT) AS u, grp = 'even' AS given, CAST(sum(value) AS BIGINT) AS v FROM run_values GROUP BY ALL",
    "sizes": "SELECT count(*) AS a, count(*) FILTER (given) AS f FROM units",
    "drawn": f"""
  SELECT p, v, CASE WHEN p = 0 THEN given ELSE ((((u % {compare.MODULUS}) * {compare.FACTOR} + p * {compare.STEP}) % {compare.MODULUS}) * {compare.FACTOR})
         % {compare.MODULUS} * a < f * {compare.MODULUS} END AS i
  FROM units CROSS JOIN sizes CROSS JOIN (SELECT unnest(range({compare.RELABELLINGS} + 1)) AS p)""",
    "means": """
  SELECT p, count(*) FILTER (i) AS n1, count(*) FILTER (NOT i) AS n0, CAST(sum(v) FILTER (i) AS DOUBLE) / nullif(count(*) FILTER (i), 0) AS m1,
         CAST(sum(v) FILTER (NOT i) AS DOUBLE) / nullif(count(*) FILTER (NOT i), 0) AS m0 FROM drawn GROUP BY p"""}, """
SELECT r.n1 AS n_first, r.n0 AS n_rest, round(r.m1, 6) AS mean_first, round(r.m0, 6) AS mean_rest, round(r.m1 - r.m0, 6) AS difference,
       round(CAST((SELECT count(*) FROM means m WHERE abs(m.m1 - m.m0) >= abs(r.m1 - r.m0)) AS DOUBLE) / (SELECT count(*) FROM means WHERE m1 - m0 IS NOT NULL), 6) AS p
FROM means r WHERE r.p = 0""")
_add("recorded_runs", RUN_VALUES, "SELECT grp, run_id, pairing, value FROM run_values")

# The cleaning run: five criteria and the log

FIVE = {
    **CORR, "amps": AMPS, "scored_amp": _robust("amp", "amps"), "filtered": _fir("usable", SMOOTH), "low": _mad("y", "filtered"),
    "rest": "SELECT rec_id, ch_idx, t, x - y AS y FROM filtered", "high": _mad("y", "rest"), "noises": NOISE, "scored_noise": _robust("noise", "noises"),
    "fractions": f"SELECT rec_id, ch_idx, avg(CASE WHEN corr < {quality.CORR_LIMIT} THEN CAST(1 AS DOUBLE) ELSE 0 END) AS fraction FROM corrs GROUP BY ALL",
    "found": f"""
  SELECT rec_id, ch_idx, 'nan' AS criterion FROM bad_nan UNION ALL SELECT rec_id, ch_idx, 'flat' FROM bad_flat
  UNION ALL SELECT rec_id, ch_idx, 'deviation' FROM scored_amp WHERE abs(z) > {quality.Z_LIMIT}
  UNION ALL SELECT rec_id, ch_idx, 'hf_noise' FROM scored_noise WHERE z > {quality.Z_LIMIT}
  UNION ALL SELECT rec_id, ch_idx, 'correlation' FROM fractions WHERE fraction > {quality.CORR_FRACTION}""",
}
_add("bad_channels", FIVE, "SELECT rec_id, ch_idx, criterion FROM found")
_add("cleaning_log", {**FIVE, "listed": LISTED,
    "recs": f"SELECT CAST(user_id // {fx.GROUP} AS VARCHAR) AS rec_id, count(*) AS n, min(user_id) AS first FROM users GROUP BY 1",
    "chosen": "SELECT r.rec_id, (a % 4) || ',' || (b % 4) || ',' || a AS comps FROM recs r JOIN listed l ON l.rec_id = CAST(r.first AS VARCHAR)",
    "bads": """
  SELECT rec_id, count(DISTINCT ch_idx) AS n_bad, string_agg(CASE WHEN criterion = 'hf_noise' THEN CAST(ch_idx AS VARCHAR) END, ',' ORDER BY ch_idx) AS noisy
  FROM found GROUP BY 1""",
    "told": "SELECT r.rec_id, r.n, coalesce(b.n_bad, 0) AS n_bad, b.noisy, c.comps FROM recs r LEFT JOIN bads b USING (rec_id) LEFT JOIN chosen c USING (rec_id)"}, f"""
SELECT rec_id AS original_file, 0 AS pos, 'load_data' AS step, 'Loaded recording' AS description, CAST(n AS VARCHAR) AS param, CAST(NULL AS VARCHAR) AS noisy FROM told
UNION ALL SELECT rec_id, 1, 'highpass_filter', 'Applied {filters.HIGHPASS_HZ:.1f} Hz high-pass filter', '{filters.HIGHPASS_HZ}', NULL FROM told
UNION ALL SELECT rec_id, 2, 'bad_channel_detection', 'Identified bad channels', CAST(n_bad AS VARCHAR), noisy FROM told
UNION ALL SELECT rec_id, 3, 'interpolate_bads', 'Interpolated bad channels', CAST(n_bad AS VARCHAR), NULL FROM told
UNION ALL SELECT rec_id, 4, 'ica_fit', 'Fitted components', '4', NULL FROM told
UNION ALL SELECT rec_id, 5, 'ica_apply', 'Removed chosen components', coalesce(comps, ''), NULL FROM told""")
