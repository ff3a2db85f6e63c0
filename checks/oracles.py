"""DuckDB twins of the registered queries, written from the definitions rather than from the Spark code.

Spectra are plain discrete Fourier sums, recurrences are recursive CTEs and zero-phase filters
are convolutions with an impulse response that is itself produced by a recursive CTE.
"""

from __future__ import annotations

import re

from rillwave.functions.filters import butter_sections, notch_section, pad_length
from rillwave.model import REGIONS

PI2 = "6.283185307179586"


def r6(x: str, name: str) -> str:
    return f"CASE WHEN abs({x}) < 5e-7 THEN 0.0 ELSE round({x}, 6) END AS {name}"


def case_map(x: str, d: dict, default: str = "NULL") -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in d.items()) + f" ELSE {default} END"


# --- recordings ---------------------------------------------------------------------------------
E = """e AS (
  SELECT c.channel, (s.vec_id * 32 + r.i) // 512 AS epoch_ix, (s.vec_id * 32 + r.i) % 512 AS pos, s.vec_id * 32 + r.i AS sample_ix,
         CAST(s.embedding[c.base + r.i + 1] AS DOUBLE) * 100.0 AS uv
  FROM embeddings s, (VALUES ('A', 0), ('B', 32)) c(channel, base), range(32) r(i)),
whole AS (SELECT epoch_ix FROM e WHERE channel = 'A' GROUP BY 1 HAVING count(*) = 512),
ep AS (SELECT e.* FROM e JOIN whole USING (epoch_ix))"""

WEAR = """w AS (
  SELECT c.channel, s.vec_id * 16 + r.i AS sample_ix, CAST(s.embedding[c.base + r.i + 1] AS DOUBLE) * 100.0 AS uv
  FROM embeddings s, (VALUES ('TP9', 0), ('AF7', 16), ('AF8', 32), ('TP10', 48)) c(channel, base), range(16) r(i))"""


def held(names: dict[str, tuple[str, str]], age: float) -> str:
    """Latest track value at every sample of E, expired after ``age`` seconds."""
    track = " UNION ALL ".join(
        f"SELECT '{n}' AS name, CAST(event_id AS DOUBLE) AS tt, {v} AS v FROM events WHERE event_type = '{t}'"
        for n, (t, v) in names.items())
    vals = ", ".join(f"('{n}')" for n in names)
    return f"""clock AS (SELECT vec_id * 32 + i AS sample_ix, (vec_id * 32 + i) / 128.0::DOUBLE AS t FROM embeddings, range(32) r(i)),
track AS ({track}),
held AS (SELECT c.sample_ix, c.name, CASE WHEN c.t - k.tt <= {age} THEN k.v END AS value
  FROM (SELECT clock.*, n.name FROM clock, (VALUES {vals}) n(name)) c
  ASOF LEFT JOIN track k ON k.name = c.name AND c.t >= k.tt)"""


LOUD = held({"SQI": ("view", "100.0 - value * 0.2"), "EMG": ("click", "value * 0.5")}, 60.0)
QUIET = held({"SQI": ("view", "100.0 - value * 0.05"), "EMG": ("click", "value * 0.2")}, 60.0)


def judged(amp: float, flat: float, sqi: float, span: int, tag: str = "") -> str:
    """Verdicts over ``span`` consecutive epochs ending with each epoch."""
    sql = f"""ends AS (SELECT epoch_ix AS last_ix FROM whole WHERE epoch_ix >= {span - 1}),
sig AS (SELECT last_ix AS epoch_ix, channel, max(abs(uv)) AS pk, stddev_pop(uv) AS sd
  FROM ends JOIN ep ON ep.epoch_ix BETWEEN last_ix - {span - 1} AND last_ix GROUP BY 1, 2),
sig2 AS (SELECT epoch_ix, max(pk) AS max_abs, min(sd) AS min_sd FROM sig GROUP BY 1),
num AS (SELECT last_ix AS epoch_ix, name, count(*) - count(value) AS gaps, min(value) AS lo, max(value) AS hi
  FROM ends JOIN held ON sample_ix // 512 BETWEEN last_ix - {span - 1} AND last_ix GROUP BY 1, 2),
v AS (SELECT s.*, q.gaps > 0 AS qgap, q.lo AS qlo, q.hi AS qhi, m.gaps > 0 AS mgap, m.hi AS mhi
  FROM sig2 s JOIN num q ON q.epoch_ix = s.epoch_ix AND q.name = 'SQI' JOIN num m ON m.epoch_ix = s.epoch_ix AND m.name = 'EMG'),
verdict AS (SELECT *, concat_ws(';', CASE WHEN max_abs > {amp} THEN 'amplitude_outlier' END,
    CASE WHEN min_sd < {flat} THEN 'flat_signal' END,
    CASE WHEN qgap THEN 'missing_sqi' WHEN qlo < 0 OR qhi > 100 THEN 'invalid_sqi' WHEN qlo < {sqi} THEN 'low_sqi' END) AS quality_reasons,
    CASE WHEN mgap THEN 'emg_quality_unknown' WHEN mhi >= 40 THEN 'possible_muscle_contamination' ELSE '' END AS quality_warnings
  FROM v)"""
    if tag:
        for name in ("verdict", "ends", "sig2", "sig", "num"):
            sql = re.sub(rf"\b{name}\b", name + tag, sql)
        sql = sql.replace("v AS (SELECT s.*", f"v{tag} AS (SELECT s.*").replace("FROM v)", f"FROM v{tag})")
    return sql


STRICT = judged(45.0, 12.0, 70.0, 1)


def dft(source: str, key: str, fs: int, bins: int, seg: int = 256, hop: int = 128, parts: int = 3) -> str:
    """Welch density of rows (key..., pos, uv) in ``source``: psd(key..., k, p)."""
    return f"""seg AS (SELECT {key}, s, pos - s * {hop} AS n, uv - avg(uv) OVER (PARTITION BY {key}, s) AS x
  FROM {source}, range({parts}) g(s) WHERE pos >= s * {hop} AND pos < s * {hop} + {seg}),
win AS (SELECT {key}, s, n, x * (0.5 - 0.5 * cos({PI2} * n / {seg}.0)) AS x FROM seg),
ft AS (SELECT {key}, s, k, sum(x * cos({PI2} * ((k * n) % {seg}) / {seg}.0)) AS re, sum(x * sin({PI2} * ((k * n) % {seg}) / {seg}.0)) AS im
  FROM win, range({bins}) b(k) GROUP BY {key}, s, k),
psd AS (SELECT {key}, k, avg((re * re + im * im) * CASE WHEN k IN (0, {seg // 2}) THEN 1 ELSE 2 END / ({fs} * {seg * 3 / 8})) AS p
  FROM ft GROUP BY {key}, k)"""


SPEC = dft("ep", "channel, epoch_ix", 128, 129)
BANDS = {"delta": (1, 8), "theta": (8, 16), "alpha": (16, 26), "beta": (26, 60), "gamma": (60, 80)}


def area(lo: int, hi: int) -> str:
    return f"0.5 * (sum(p) FILTER (WHERE k BETWEEN {lo} AND {hi}) - 0.5 * sum(p) FILTER (WHERE k IN ({lo}, {hi})))"


POWERS = ("pw AS (SELECT channel, epoch_ix, " + ", ".join(f"{area(*b)} AS {n}" for n, b in BANDS.items())
          + f", {area(1, 80)} AS total FROM psd GROUP BY 1, 2)")
POWER_OUT = ", ".join(r6(n, f"{n}_power_uv2") for n in BANDS) + ", " + r6("total", "total_power_uv2")
SEF = """grid AS (SELECT channel, epoch_ix, k, p, coalesce((p + lag(p) OVER o) / 2 * 0.5, 0) AS mass FROM psd WHERE k BETWEEN 1 AND 80
  WINDOW o AS (PARTITION BY channel, epoch_ix ORDER BY k)),
cum AS (SELECT *, sum(mass) OVER (PARTITION BY channel, epoch_ix ORDER BY k) AS c, sum(mass) OVER (PARTITION BY channel, epoch_ix) * 0.95 AS goal FROM grid),
sef AS (SELECT channel, epoch_ix, min_by((k - 1) * 0.5 + (goal - (c - mass)) / mass * 0.5, k) AS sef FROM cum WHERE c >= goal GROUP BY 1, 2)"""
ENT = """ent AS (SELECT channel, epoch_ix, -sum(q * ln(q)) / ln(80) AS ent FROM (
  SELECT channel, epoch_ix, p / sum(p) OVER (PARTITION BY channel, epoch_ix) AS q FROM psd WHERE k BETWEEN 1 AND 80) GROUP BY 1, 2)"""


# --- zero-phase filters by convolution -------------------------------------------------------------

def zero_phase(tag: str, source: str, sos, n: int) -> str:
    """``source``(id..., x list of n) -> ``tag``(id, x): forward and backward with odd extension."""
    edge = pad_length(sos)
    size = n + 2 * edge
    m = len(sos)
    state = ", ".join(f"0.0::DOUBLE AS p{i}, 0.0::DOUBLE AS q{i}" for i in range(m))
    # one impulse through the cascade: section i maps v{i} to v{i+1}
    lines, v = [], "CASE WHEN i = 0 THEN 1.0 ELSE 0.0 END"
    inner = f"SELECT i, {', '.join(f'p{j}, q{j}' for j in range(m))}, {v}::DOUBLE AS v0 FROM {tag}_h WHERE i < {size}"
    for j, (b0, *_rest) in enumerate(sos):
        inner = f"SELECT *, {float(b0)!r} * v{j} + p{j} AS v{j + 1} FROM ({inner})"
    nxt = ", ".join(f"{float(b1)!r} * v{j} - ({float(a1)!r}) * v{j + 1} + q{j}, {float(b2)!r} * v{j} - ({float(a2)!r}) * v{j + 1}"
                    for j, (_, b1, b2, _, a1, a2) in enumerate(sos))
    dc = 1.0
    for b0, b1, b2, _, a1, a2 in sos:
        dc *= (b0 + b1 + b2) / (1 + a1 + a2)
    def run(src, out):
        return f"""{out} AS (SELECT id, list_reverse(list_transform(range(1, {size + 1}), lambda i: list_dot_product(x[1:i], r[{size + 1} - i:{size}]) + x[1] * c[i])) AS x
  FROM {src}, {tag}_k)"""
    return f"""{tag}_h AS (SELECT 0 AS i, {state}, 0.0::DOUBLE AS y UNION ALL SELECT i + 1, {nxt}, v{m} FROM ({inner})),
{tag}_s AS (SELECT i, y, {float(dc)!r} - sum(y) OVER (ORDER BY i) AS c FROM {tag}_h WHERE i > 0),
{tag}_k AS (SELECT list(y ORDER BY i DESC) AS r, list(c ORDER BY i) AS c FROM {tag}_s),
{tag}_e AS (SELECT id, list_concat(list_transform(range({edge}, 0, -1), lambda j: 2 * x[1] - x[1 + j]), x,
    list_transform(range(1, {edge + 1}), lambda j: 2 * x[{n}] - x[{n} - j])) AS x FROM {source}),
{run(f"{tag}_e", f"{tag}_f")},
{run(f"{tag}_f", f"{tag}_b")},
{tag} AS (SELECT id, x[{edge + 1}:{edge + n}] AS x FROM {tag}_b)"""


LISTS = "src AS (SELECT {'channel': channel, 'epoch_ix': epoch_ix} AS id, list(uv ORDER BY pos) AS x FROM ep GROUP BY channel, epoch_ix)"
WINDOWS = """starts AS (SELECT g AS window_ix FROM range((SELECT (max(sample_ix) + 1 - 512) // 256 + 1 FROM w)) t(g)),
wl AS (SELECT channel, window_ix, sample_ix - window_ix * 256 AS pos, uv FROM starts JOIN w ON sample_ix BETWEEN window_ix * 256 AND window_ix * 256 + 511),
src AS (SELECT {'channel': channel, 'window_ix': window_ix} AS id, list(uv ORDER BY pos) AS x FROM wl GROUP BY channel, window_ix)"""
LIVE = (WEAR + ",\n" + WINDOWS + ",\n" + zero_phase("bp", "src", butter_sections(4, 1.0, 45.0, 256.0), 512) + ",\n"
        + zero_phase("n50", "bp", butter_sections(2, 48.0, 52.0, 256.0, stop=True), 512) + ",\n"
        + zero_phase("n60", "n50", butter_sections(2, 58.0, 62.0, 256.0, stop=True), 512)
        + ",\nflt AS (SELECT id.channel AS channel, id.window_ix AS window_ix, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS uv FROM n60),\n"
        + dft("flt", "channel, window_ix", 256, 45)
        + """,
okw AS (SELECT window_ix, bool_and(swing <= 250 AND sd >= 0.5) AS ok FROM (
  SELECT channel, window_ix, max(uv) - min(uv) AS swing, stddev_pop(uv) AS sd FROM wl GROUP BY 1, 2) GROUP BY 1),
bp4 AS (SELECT channel, window_ix, sum(p) FILTER (WHERE k BETWEEN 1 AND 3) AS de, sum(p) FILTER (WHERE k BETWEEN 4 AND 7) AS th,
  sum(p) FILTER (WHERE k BETWEEN 8 AND 12) AS al, sum(p) FILTER (WHERE k BETWEEN 13 AND 29) AS be, sum(p) FILTER (WHERE k BETWEEN 30 AND 44) AS hi
  FROM psd GROUP BY 1, 2),
ch AS (SELECT channel, window_ix, al / (de + th + al + be + 1e-12) AS alpha_rel, th / (de + th + al + be + 1e-12) AS theta_rel,
  ln(be + 1e-12) - ln(al + 1e-12) AS beta_alpha_ratio, ln(hi + 1e-12) AS muscle_tension, ln(al + 1e-12) AS la FROM bp4)""")

# --- sessions ---------------------------------------------------------------------------------------
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
SESSIONS = f"""raw AS (SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(event_id AS DOUBLE) AS t, event_type <> 'error' AS ok, value AS v, {K} AS k FROM events),
ses AS (SELECT session_id, t, ok, k, 1 / (1 + v / 50.0) AS alpha_rel, 1 / (2 + v / 40.0) AS theta_rel, ln(v + 1.0) AS beta_alpha_ratio,
  ln(v + k / 10.0 + 1.0) AS muscle_tension, k / 50.0 - 1.0 AS frontal_asymmetry FROM raw),
cln AS (SELECT session_id, t, beta_alpha_ratio AS x, row_number() OVER (PARTITION BY session_id ORDER BY t) AS rn FROM ses WHERE ok)"""
FEATS = ("alpha_rel", "theta_rel", "beta_alpha_ratio", "muscle_tension", "frontal_asymmetry")
CALIB = f"""kth AS (SELECT session_id, max(t) AS t8 FROM (SELECT session_id, t, row_number() OVER (PARTITION BY session_id ORDER BY t) AS rn FROM ses WHERE ok)
  WHERE rn <= 8 GROUP BY 1 HAVING count(*) = 8),
fin AS (SELECT s.session_id, min(t) AS cal_t FROM ses s JOIN kth USING (session_id) WHERE t >= greatest(t8, 2000.0) GROUP BY 1),
calm AS (SELECT s.* FROM ses s JOIN fin USING (session_id) WHERE ok AND t <= cal_t),
cf AS (UNPIVOT (SELECT session_id, t, {', '.join(FEATS)} FROM calm) ON {', '.join(FEATS)} INTO NAME feature VALUE x),
md AS (SELECT session_id, feature, median(x) AS med, count(*) AS n FROM cf GROUP BY 1, 2),
bl AS (SELECT session_id, feature, med, any_value(n) AS n, median(abs(x - med)) * 1.4826 AS mad, greatest(median(abs(x - med)) * 1.4826, 1e-6, 0.05 * abs(med)) AS scale
  FROM cf JOIN md USING (session_id, feature) GROUP BY 1, 2, 3)"""
WEIGHTS = {"beta_alpha_ratio": 1.0, "alpha_rel": -1.0, "theta_rel": -0.3, "frontal_asymmetry": -0.5, "muscle_tension": 0.7}
OBS = "obs AS (SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(event_id AS DOUBLE) AS t, CAST(bit_count(CAST(" + K + " % 64 AS BIGINT)) AS INTEGER) AS score FROM events WHERE event_type = 'signup')"
BAND = "CASE WHEN score <= 0 THEN 'low' WHEN score <= 2 THEN 'moderate' WHEN score > 2 THEN 'very_high' END"
MULT = "CASE band WHEN 'low' THEN 1.0 WHEN 'moderate' THEN 0.8 WHEN 'very_high' THEN 0.65 ELSE 1.0 END::DOUBLE"
OFFS = "CASE band WHEN 'low' THEN 0.0 WHEN 'moderate' THEN -0.25 WHEN 'very_high' THEN -0.5 ELSE 0.0 END::DOUBLE"
WITH_BVC = f"""{OBS}, cur AS (SELECT s.session_id, s.t, CASE WHEN s.t - o.t <= 3000 THEN o.score END AS score, CASE WHEN s.t - o.t <= 3000 THEN o.t END AS obs_t
  FROM ses s ASOF LEFT JOIN obs o ON o.session_id = s.session_id AND s.t >= o.t),
bvc AS (SELECT session_id, t, coalesce(score, 0) AS score, obs_t, coalesce({BAND}, 'none') AS band FROM cur)"""
ALPHA = 1 - __import__("math").exp(-1 / 20)

EVAL = """ev AS (SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(event_id AS DOUBLE) AS t, event_type, value FROM events),
truth AS (SELECT session_id, t AS event_t FROM ev WHERE event_type = 'purchase'),
al AS (SELECT session_id, t AS alert_t, CASE event_type WHEN 'click' THEN 'EARLY_WARNING' ELSE 'IMMINENT' END AS level FROM ev WHERE event_type IN ('click', 'view')),
lead AS (SELECT session_id, event_t, min(alert_t) FILTER (WHERE level = 'EARLY_WARNING') AS e, min(alert_t) FILTER (WHERE level = 'IMMINENT') AS i
  FROM truth LEFT JOIN al USING (session_id) WHERE alert_t IS NULL OR TRUE GROUP BY 1, 2),
hit AS (SELECT t.session_id, t.event_t, min(alert_t) FILTER (WHERE level = 'EARLY_WARNING') AS e, min(alert_t) FILTER (WHERE level = 'IMMINENT') AS i
  FROM truth t LEFT JOIN al a ON a.session_id = t.session_id AND a.alert_t BETWEEN t.event_t - 900 AND t.event_t GROUP BY 1, 2),
wrong AS (SELECT * FROM al a WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.session_id = a.session_id AND t.event_t - a.alert_t BETWEEN 0 AND 720))"""
# minutes to two decimals, halves to even as decimals: whole seconds / 60 never sit on a half
LEAD = "round((event_t - {c}) / 60.0, 2)"

PRED = """pr AS (SELECT o_custkey AS subject_id, (['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])[CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS pred,
  c_mktsegment AS truth FROM orders JOIN customer ON c_custkey = o_custkey)"""
VOTE = """cnt AS (SELECT subject_id, truth, pred, count(*) AS n FROM pr GROUP BY 1, 2, 3),
vt AS (SELECT subject_id, truth, pred, sum(n) OVER (PARTITION BY subject_id) AS epochs, row_number() OVER (PARTITION BY subject_id ORDER BY n DESC, pred) AS rn FROM cnt),
vote AS (SELECT subject_id, truth, pred, CAST(epochs AS BIGINT) AS epochs FROM vt WHERE rn = 1)"""


def metrics(src: str) -> str:
    return f"""lab AS (SELECT truth AS label FROM {src} UNION SELECT pred FROM {src}),
sc AS (SELECT label, count(*) FILTER (WHERE truth = label AND pred = label) AS h, count(*) FILTER (WHERE truth = label) AS s, count(*) FILTER (WHERE pred = label) AS g
  FROM lab, {src} GROUP BY 1)
SELECT {r6("avg(CASE WHEN s > 0 THEN h / s END)", "balanced_accuracy")}, {r6("avg(2.0 * h / (s + g))", "macro_f1")} FROM sc"""


COMP = ("alpha_variance", "gating_efficiency", "posterior_gamma", "frontoparietal_plv", "autonomic_surge", "temporal_csd",
        "delta_alpha_ratio", "bifrontal_bicoherence", "hemispheric_asymmetry", "frontotemporal_coherence")
CALROWS = f"""er AS (SELECT event_id, CAST(user_id AS VARCHAR) AS subject_id, event_type IN ('view', 'click', 'signup') AS calm, event_id * 60.0::DOUBLE AS a, event_id * 60.0 + value * 120.0 AS b,
  value AS v, CAST({K} AS DOUBLE) AS k FROM events),
cr AS (SELECT event_id, subject_id, calm, a, b, sqrt(v) / 3.0 AS alpha_variance, sqrt(k + 1.0) / 7.0 AS gating_efficiency, sqrt(v + k) AS posterior_gamma, ln(k + 2.0) AS frontoparietal_plv,
  ln(v + 1.0) AS autonomic_surge, sqrt(v) - sqrt(k) AS temporal_csd, v / (k + 1.0) AS delta_alpha_ratio, sqrt(v) / 10.0 AS bifrontal_bicoherence, exp(-k / 50.0) AS hemispheric_asymmetry,
  1.0 / (k + 1.0) AS frontotemporal_coherence FROM er),
iv AS (SELECT subject_id, a, b, max(b) OVER (PARTITION BY subject_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM cr WHERE calm),
du AS (SELECT subject_id, sum(greatest(0, b - greatest(a, coalesce(p, a)))) AS duration_s FROM iv GROUP BY 1),
lg AS (UNPIVOT (SELECT subject_id, {', '.join(COMP)} FROM cr WHERE calm) ON {', '.join(COMP)} INTO NAME component VALUE x),
st AS (SELECT subject_id, component, avg(x) AS mean, stddev_samp(x) AS sd, count(x) AS n FROM lg GROUP BY 1, 2),
pb AS (SELECT subject_id, count(*) FILTER (WHERE NOT coalesce(sd > 0, false)) + CASE WHEN max(n) < 3 THEN 1 ELSE 0 END AS n_problems FROM st GROUP BY 1)"""


def composite() -> str:
    dirs = dict(zip(COMP[:5], (1, -1, 1, -1, 1)))
    order = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(COMP))
    return f"""fl AS (SELECT event_id, subject_id, component, x FROM (SELECT event_id, subject_id, {', '.join(COMP)} FROM cr WHERE NOT calm) UNPIVOT INCLUDE NULLS (x FOR component IN ({', '.join(COMP)}))),
sub AS (SELECT event_id, f.subject_id, component, CASE component {order} END AS o, component IN ({', '.join(f"'{c}'" for c in COMP[:5])}) AS is_soi, duration_s,
  CASE WHEN x IS NULL THEN NULL WHEN component IN ({', '.join(f"'{c}'" for c in COMP[:5])})
    THEN least(100.0, greatest(0.0, 100 * {case_map("component", dirs, "1")} * (x - mean) / (3 * sd)))
    ELSE least(100.0, greatest(0.0, 100 * (1 - abs(x - mean) / (3 * sd)))) END AS s
  FROM fl f JOIN st USING (subject_id, component) JOIN pb USING (subject_id) JOIN du USING (subject_id) WHERE n_problems = 0),
ag AS (SELECT event_id, subject_id, any_value(duration_s) AS d, sum(0.2 * s) FILTER (WHERE is_soi) AS soi, count(s) FILTER (WHERE is_soi) AS ns,
  sum(0.2 * s) FILTER (WHERE NOT is_soi) AS rdi, count(s) FILTER (WHERE NOT is_soi) AS nr, coalesce(string_agg(component, ',' ORDER BY o) FILTER (WHERE is_soi AND s IS NULL), '') AS soi_missing
  FROM sub GROUP BY 1, 2)
SELECT event_id, subject_id, {r6("CASE WHEN ns = 5 AND d >= 86400 THEN soi END", "soi")}, {r6("CASE WHEN nr = 5 AND d >= 86400 THEN rdi END", "rdi")},
  {r6("ns / 5.0::DOUBLE", "soi_coverage")}, soi_missing, CASE WHEN d < 86400 THEN 'calibration_shorter_than_article_24h' ELSE '' END AS issues FROM ag
UNION ALL SELECT DISTINCT event_id, subject_id, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL, 'no calibration of this subject and medication profile'
  FROM fl WHERE NOT EXISTS (SELECT 1 FROM ag WHERE ag.event_id = fl.event_id)"""


# Sessions by gaps and islands: what is known when the first wave has been read, and what the second one adds.
EVENT_SESSIONS = f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, epoch_us(ts) // 1000 AS tm, value, event_id % 10 = 7 AS later FROM events),
w AS (SELECT max(tm) FILTER (WHERE NOT later) - 1800000 AS w1, max(tm) - 1800000 AS w2 FROM e),
i1 AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY tm ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN tm - lag(tm) OVER (PARTITION BY session_id ORDER BY tm) <= 3600000 THEN 0 ELSE 1 END AS new FROM e WHERE NOT later)),
s1 AS (SELECT session_id, island, min(tm) AS start_ms, max(tm) AS end_ms, count(*) AS n, sum(value) AS total FROM i1 GROUP BY 1, 2),
rest AS (SELECT i1.session_id, i1.tm, i1.value FROM i1 JOIN s1 USING (session_id, island), w WHERE end_ms + 3600000 >= w1
  UNION ALL SELECT session_id, tm, value FROM e, w WHERE later AND tm >= w1),
i2 AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY tm ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN tm - lag(tm) OVER (PARTITION BY session_id ORDER BY tm) <= 3600000 THEN 0 ELSE 1 END AS new FROM rest)),
s2 AS (SELECT session_id, island, min(tm) AS start_ms, max(tm) AS end_ms, count(*) AS n, sum(value) AS total FROM i2 GROUP BY 1, 2),
alls AS (SELECT session_id, 'SESSION' AS kind, start_ms, end_ms, n, total FROM s1, w WHERE end_ms + 3600000 < w1
  UNION ALL SELECT session_id, 'SESSION', start_ms, end_ms, n, total FROM s2, w WHERE end_ms + 3600000 < w2
  UNION ALL SELECT session_id, 'LATE', tm, tm, 1, value FROM e, w WHERE later AND tm < w1)
SELECT session_id, kind, start_ms, end_ms, n, {r6("total", "total")} FROM alls"""


def bicoherence_ctes() -> str:
    return f"""s1 AS (SELECT channel, g AS seg, sample_ix - g * 128 AS n, uv - avg(uv) OVER (PARTITION BY channel, g) AS x
  FROM e, range((SELECT max(sample_ix) // 128 FROM e)) t(g) WHERE sample_ix BETWEEN g * 128 AND g * 128 + 255),
f1 AS (SELECT channel, seg, k, sum(x * (0.5 - 0.5 * cos({PI2} * n / 256.0)) * cos({PI2} * ((k * n) % 256) / 256.0)) AS re,
  -sum(x * (0.5 - 0.5 * cos({PI2} * n / 256.0)) * sin({PI2} * ((k * n) % 256) / 256.0)) AS im FROM s1, range(10, 61) b(k) GROUP BY 1, 2, 3),
tri AS (SELECT a.channel, a.seg, a.k AS i, b.k AS j, a.re * b.re - a.im * b.im AS pr, a.re * b.im + a.im * b.re AS pi, c.re AS cr, c.im AS ci
  FROM f1 a JOIN f1 b ON b.channel = a.channel AND b.seg = a.seg AND a.k <= b.k AND a.k <= 30 AND b.k <= 30 AND a.k + b.k <= 60
  JOIN f1 c ON c.channel = a.channel AND c.seg = a.seg AND c.k = a.k + b.k),
tot AS (SELECT t.channel, h.last_ix AS epoch_ix, i, j, sum(pr * cr + pi * ci) AS nr, sum(pi * cr - pr * ci) AS ni, sum(pr * pr + pi * pi) AS dp, sum(cr * cr + ci * ci) AS ds
  FROM ends h JOIN tri t ON t.seg BETWEEN (h.last_ix - 14) * 4 AND (h.last_ix - 14) * 4 + 58 GROUP BY 1, 2, 3, 4),
bic AS (SELECT channel, epoch_ix, avg(least(1.0, greatest(0.0, (nr * nr + ni * ni) / (dp * ds)))) AS b FROM tot WHERE dp * ds > 2.2250738585072014e-308 GROUP BY 1, 2)"""


def bicoherence() -> str:
    return f"""WITH {E}, {QUIET}, {judged(300.0, 0.05, 80.0, 15)}, {bicoherence_ctes()}
SELECT c.channel, w.epoch_ix, {r6("CASE WHEN d.quality_reasons = '' AND d.quality_warnings = '' THEN b END", "auto_bicoherence_squared_60s")}
FROM whole w CROSS JOIN (VALUES ('A'), ('B')) c(channel) LEFT JOIN verdict d ON d.epoch_ix = w.epoch_ix LEFT JOIN bic ON bic.channel = c.channel AND bic.epoch_ix = w.epoch_ix"""


def phase_locking() -> str:
    n = 512
    kernel = (f"hk AS (SELECT list(CASE WHEN m % 2 = 0 THEN 0.0 ELSE 2.0 / {n} / tan({PI2} / 2 * m / {n}) END ORDER BY i) AS c FROM "
              f"(SELECT i, ((i - {n - 1}) % {n} + {n}) % {n} AS m FROM range({2 * n - 1}) t(i)))")
    return f"""WITH RECURSIVE {E}, {LISTS}, {zero_phase("bp", "src", butter_sections(4, 8.0, 13.0, 128.0), n)}, {kernel},
an AS (SELECT id.channel AS channel, id.epoch_ix AS epoch_ix, x, list_transform(range(1, {n + 1}), lambda i: list_dot_product(list_reverse(x), c[i:i + {n - 1}])) AS y FROM bp, hk),
pt AS (SELECT channel, epoch_ix, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS re, unnest(y) AS im FROM an),
pp AS (SELECT a.epoch_ix, a.re * b.re + a.im * b.im AS cr, a.im * b.re - a.re * b.im AS ci FROM pt a JOIN pt b ON b.channel = 'B' AND b.epoch_ix = a.epoch_ix AND b.pos = a.pos
  WHERE a.channel = 'A' AND a.pos BETWEEN 64 AND 447)
SELECT epoch_ix, 'pair_Fp1_P3__alpha_plv' AS pair, {r6("sqrt(avg(cr / sqrt(cr * cr + ci * ci)) ** 2 + avg(ci / sqrt(cr * cr + ci * ci)) ** 2)", "alpha_plv")} FROM pp GROUP BY 1"""



# --- the detector as a recursive query ------------------------------------------------------------------

def detector(mult: bool, kalman: bool = False) -> str:
    """Sequential detector over the event sessions: one recursion step per window after calibration.

    Constants are those of the registered session configuration.
    """
    up, level_at, k, h = (6.0, "6.0", 2.0, 150.0) if kalman else (1.0, "1.0", 0.3, 2.0)
    win = f"""qw AS (SELECT *, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY session_id ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS quality FROM ses),
mon AS (SELECT q.*, {MULT if mult else "1.0::DOUBLE"} AS mult, {OFFS if mult else "0.0::DOUBLE"} AS offs, {"b.band, b.obs_t" if mult else "'none' AS band, NULL::DOUBLE AS obs_t"},
  row_number() OVER (PARTITION BY q.session_id ORDER BY q.t) AS rn FROM qw q JOIN fin USING (session_id) {"JOIN bvc b ON b.session_id = q.session_id AND b.t = q.t" if mult else ""} WHERE q.t > cal_t)"""
    piv = ("pv AS (SELECT session_id, " + ", ".join(f"max(med) FILTER (WHERE feature = '{f}') AS m_{f}, max(scale) FILTER (WHERE feature = '{f}') AS s_{f}" for f in FEATS)
           + " FROM bl GROUP BY 1)")
    ms = ", ".join(f"m_{f}" for f in FEATS)
    ss = ", ".join(f"s_{f}" for f in FEATS)
    index = "(" + " + ".join(f"({WEIGHTS[f]}) * ({f} - m_{f}) / s_{f}" for f in FEATS) + ") / sqrt(3.5)"
    prior = f"""init AS (SELECT session_id, {ms}, {ss}, NULL::DOUBLE AS level, []::DOUBLE[] AS tt, []::DOUBLE[] AS yy, 0.0::DOUBLE AS acc,
  NULL::DOUBLE AS e_since, NULL::DOUBLE AS i_since, NULL::DOUBLE AS e_last, NULL::DOUBLE AS i_last, TRUE AS e_arm, TRUE AS i_arm, NULL::DOUBLE AS noticed FROM pv)"""
    keep = "session_id, rn, t, ok, quality, mult, offs, band, obs_t"
    state = f"{ms}, {ss}"
    # layer by layer: raw index, level, trail, slope and sum, conditions, timers, firing
    src = f"""SELECT w.session_id, w.rn, w.t, w.ok, w.quality, w.mult, w.offs, w.band, w.obs_t, {", ".join("w." + f for f in FEATS)}, {", ".join("p." + c for c in (ms + ", " + ss).split(", "))},
      p.level AS level0, p.tt AS tt0, p.yy AS yy0, p.acc AS acc0, p.e_since AS e0, p.i_since AS i0, p.e_last AS el0, p.i_last AS il0, p.e_arm AS ea0, p.i_arm AS ia0, p.noticed AS no0
      FROM PREVIOUS p JOIN mon w ON w.session_id = p.session_id AND w.rn = NEXT"""
    a = f"SELECT *, {index} AS raw FROM ({src})"
    b = f"SELECT *, CASE WHEN level0 IS NULL THEN raw ELSE level0 + {ALPHA!r} * (raw - level0) END AS lv FROM ({a})"
    c = f"""SELECT *, list_filter(list_append(tt0, t), lambda v: v >= t - 3000) AS tt1, list_append(yy0, lv) AS yall FROM ({b})"""
    d = "SELECT *, yall[len(yall) - len(tt1) + 1:len(yall)] AS yy1 FROM (" + c + ")"
    e = f"""SELECT *, list_avg(tt1) AS mt, list_avg(yy1) AS my, greatest(0.0, acc0 + raw - {k}) AS acc1, {h} * mult AS lim, {level_at} + offs AS top FROM ({d})"""
    f_ = f"""SELECT *, CASE WHEN len(tt1) >= 10 AND tt1[len(tt1)] - tt1[1] >= 60 THEN 60 * list_dot_product(list_transform(tt1, lambda v: v - mt), list_transform(yy1, lambda v: v - my))
      / list_dot_product(list_transform(tt1, lambda v: v - mt), list_transform(tt1, lambda v: v - mt)) END AS slope,
      CASE WHEN lv < 0.3 THEN least(acc1, 0.5 * lim) ELSE acc1 END AS acc2, (ea0 OR lv < 0.5) AS ea1, (ia0 OR lv < 0.5) AS ia1 FROM ({e})"""
    g = f"""SELECT *, lv >= top AS hot, acc2 > lim AND slope IS NOT NULL AND slope >= 0.0001 AND lv < top AND ia1 AS rise,
      CASE WHEN slope > 0 AND lv < top THEN (top - lv) / slope END AS eta FROM ({f_})"""
    hh = """SELECT *, CASE WHEN hot THEN coalesce(i0, t) END AS i1, CASE WHEN hot THEN e0 WHEN rise THEN coalesce(e0, t) END AS e1 FROM (""" + g + ")"
    ii = """SELECT *, hot AND t - i1 >= 100 AND quality >= 0.6 AND ia1 AND (il0 IS NULL OR t - il0 >= 300) AS fire_i,
      NOT hot AND coalesce(rise, FALSE) AND t - e1 >= 100 AND quality >= 0.6 AND ea1 AND (el0 IS NULL OR t - el0 >= 300) AS fire_e FROM (""" + hh + ")"
    jj = "SELECT *, NOT fire_i AND NOT fire_e AND band = 'very_high' AND obs_t IS DISTINCT FROM no0 AS fire_c FROM (" + ii + ")"

    def pick(new: str, old: str, name: str) -> str:
        return f"CASE WHEN ok THEN {new} ELSE {old} END AS {name}"

    out = [f"CASE WHEN ok AND lv < 0.5 THEN m_{f} + 0.002 * ({f} - m_{f}) ELSE m_{f} END AS m_{f}" for f in FEATS] + [f"s_{f}" for f in FEATS]
    out += [pick("lv", "level0", "level"), pick("tt1", "tt0", "tt"), pick("yy1", "yy0", "yy"), pick("acc2", "acc0", "acc"), pick("e1", "e0", "e_since"),
            pick("i1", "i0", "i_since"), "CASE WHEN ok AND fire_e THEN t ELSE el0 END AS e_last", "CASE WHEN ok AND fire_i THEN t ELSE il0 END AS i_last",
            "CASE WHEN ok THEN ea1 AND NOT fire_e ELSE ea0 END AS e_arm", "CASE WHEN ok THEN ia1 AND NOT fire_i ELSE ia0 END AS i_arm",
            "CASE WHEN ok AND fire_c THEN obs_t ELSE no0 END AS noticed",
            "CASE WHEN NOT ok THEN 'LOW_QUALITY' WHEN hot THEN 'IMMINENT' WHEN rise THEN 'EARLY_WARNING' ELSE 'CALM' END AS state",
            "CASE WHEN ok THEN raw END AS raw_index", "CASE WHEN ok THEN slope END AS slope", "CASE WHEN ok THEN eta END AS eta",
            "CASE WHEN NOT ok THEN NULL WHEN fire_i THEN 'IMMINENT' WHEN fire_e THEN 'EARLY_WARNING' WHEN fire_c THEN 'CLINICAL_RISK' END AS alert_level"]
    term = f"SELECT {keep}, {', '.join(out)} FROM ({jj})"
    first = term.replace("PREVIOUS", "init").replace("w.rn = NEXT", "w.rn = 1")
    later = term.replace("PREVIOUS", "det").replace("w.rn = NEXT", "w.rn = p.rn + 1")
    return f"{win}, {piv}, {prior}, det AS ({first} UNION ALL {later})"


def kalman() -> str:
    """Level of the state-space model: noise from calm windows, output scaled by its own calm track."""
    from rillwave.functions.statespace import noise_variance
    from rillwave.plans.queries import EVENTS_CFG
    spec = noise_variance(EVENTS_CFG)
    names = ("beta_alpha_ratio", "log_alpha_rel", "log_theta_rel", "frontal_asymmetry", "muscle_tension")
    weight = dict(zip(names, (1.0, -1.0, -0.3, -0.5, 0.7)))
    y = {n: n if not n.startswith("log_") else f"ln(greatest({n[4:]}, 1e-9))" for n in names}
    cols = ", ".join(f"{y[n]} AS y{i}" for i, n in enumerate(names))
    mus, lam, rr = (", ".join(f"{c}{i}" for i in range(5)) for c in ("mu", "la", "r"))
    fit = ", ".join(f"any_value(mu{i}) AS mu{i}, {weight[n]} * greatest(median(abs(y{i} - mu{i})) * 1.4826, 1e-6) AS la{i}, "
                    f"{spec[n]!r} + greatest(greatest(median(abs(y{i} - mu{i})) * 1.4826, 1e-6) ** 2 - {spec[n]!r}, 0.1 * greatest(median(abs(y{i} - mu{i})) * 1.4826, 1e-6) ** 2) AS r{i}"
                    for i, n in enumerate(names))
    prec = "1 / (0.98 * 0.98 * p + 1 - 0.98 * 0.98)"
    gain = " + ".join(f"la{i} * la{i} / r{i}" for i in range(5))
    pull = " + ".join(f"la{i} * (y{i} - mu{i}) / r{i}" for i in range(5))
    step = f"(0.98 * a * ({prec}) + {pull}) / ({prec} + {gain})"
    var = f"1 / ({prec} + {gain})"
    ys = ", ".join(f"w.y{i}" for i in range(5))
    carry = ", ".join(f"q.{c}{i}" for c in ("mu", "la", "r") for i in range(5))
    def walk(out, src, seed, adapt):
        mu_next = ", ".join(f"CASE WHEN (na - ce) / sc < 0.5 THEN mu{i} + 0.002 * (y{i} - mu{i}) ELSE mu{i} END AS mu{i}" if adapt else f"mu{i}" for i in range(5))
        term = f"""SELECT session_id, rn, t, na AS a, np AS p, {mu_next}, {lam}, {rr}, ce, sc, (na - ce) / sc AS level FROM (
          SELECT *, {step} AS na, {var} AS np FROM (SELECT w.session_id, w.rn, w.t, {ys}, q.a, q.p, {carry}, q.ce, q.sc FROM PREV q JOIN {src} w ON w.session_id = q.session_id AND w.rn = NEXT))"""
        return f"{out} AS ({term.replace('PREV', seed).replace('NEXT', '1')} UNION ALL {term.replace('PREV', out).replace('NEXT', 'q.rn + 1')})"
    return f"""cy AS (SELECT session_id, t, row_number() OVER (PARTITION BY session_id ORDER BY t) AS rn, {cols} FROM calm),
cm AS (SELECT session_id, {", ".join(f"median(y{i}) AS mu{i}" for i in range(5))} FROM cy GROUP BY 1),
ft AS (SELECT session_id, {fit}, 0.0::DOUBLE AS a, 1.0::DOUBLE AS p, 0.0::DOUBLE AS ce, 1.0::DOUBLE AS sc FROM cy JOIN cm USING (session_id) GROUP BY 1),
{walk("k1", "cy", "ft", False)},
bn AS (SELECT session_id, a FROM (SELECT session_id, a, rn, count(*) OVER (PARTITION BY session_id) AS n FROM k1) WHERE rn > least(n // 4, 30)),
bc AS (SELECT session_id, median(a) AS ce FROM bn GROUP BY 1),
bs AS (SELECT session_id, any_value(ce) AS ce, greatest(median(abs(a - ce)) * 1.4826, 1e-3) AS sc FROM bn JOIN bc USING (session_id) GROUP BY 1),
f2 AS (SELECT session_id, {mus}, {lam}, {rr}, 0.0::DOUBLE AS a, 1.0::DOUBLE AS p, bs.ce, bs.sc FROM ft JOIN bs USING (session_id)),
my AS (SELECT session_id, t, row_number() OVER (PARTITION BY session_id ORDER BY t) AS rn, {cols} FROM ses JOIN fin USING (session_id) WHERE ok AND t > cal_t),
{walk("k2", "my", "f2", True)}"""


def onset_ctes() -> str:
    """Per channel and kind: accumulator since the last calm window and its first crossing."""
    chans = "(VALUES ('TP9', 0, 'L', 'left temporoparietal'), ('AF7', 1, 'L', 'left frontal'), ('AF8', 2, 'R', 'right frontal'), ('TP10', 3, 'R', 'right temporoparietal')) c(channel, sh, side, region)"
    val = "beta_alpha_ratio + sh * k / 100.0 AS b, alpha_rel + sh * k / 1000.0 AS al, muscle_tension + sh AS m"
    sc = lambda c: f"greatest(median(abs({c} - m{c})) * 1.4826, 1e-6, 0.05 * abs(any_value(m{c})))"
    tenth, hundredth = "CAST(format('{:.1f}', ", "CAST(format('{:.2f}', "
    return f"""cc AS (SELECT session_id, channel, {val} FROM calm, {chans}),
c1 AS (SELECT session_id, channel, median(b) AS mb, median(al) AS mal, median(m) AS mm FROM cc GROUP BY 1, 2),
c2 AS (SELECT session_id, channel, any_value(mb) AS mb, any_value(mal) AS mal, any_value(mm) AS mm, {sc("b")} AS sb, {sc("al")} AS sal, {sc("m")} AS sm FROM cc JOIN c1 USING (session_id, channel) GROUP BY 1, 2),
mv AS (SELECT d.session_id, d.t, d.level, c.channel, row_number() OVER (PARTITION BY d.session_id, c.channel ORDER BY d.t) AS rn, {val} FROM det d JOIN ses s ON s.session_id = d.session_id AND s.t = d.t, {chans} WHERE d.ok),
pushes AS (SELECT session_id, t, level, channel, rn, 'neural' AS kind, ((b - mb) / sb - (al - mal) / sal) / sqrt(2) AS x FROM mv JOIN c2 USING (session_id, channel)
  UNION ALL SELECT session_id, t, level, channel, rn, 'muscle', (m - mm) / sm FROM mv JOIN c2 USING (session_id, channel)),
os AS (SELECT session_id, channel, kind, rn, t, CASE WHEN level < 0.3 THEN 0.0 ELSE greatest(0.0, x - 0.5) END AS acc, CASE WHEN level >= 0.3 AND x - 0.5 > 1.0 THEN t END AS hit FROM pushes WHERE rn = 1
  UNION ALL SELECT session_id, channel, kind, rn, t, acc, CASE WHEN level < 0.3 THEN NULL WHEN hit0 IS NOT NULL THEN hit0 WHEN acc > 1.0 THEN t END FROM (
    SELECT w.session_id, w.channel, w.kind, w.rn, w.t, w.level, CASE WHEN w.level < 0.3 THEN 0.0 ELSE greatest(0.0, o.acc + w.x - 0.5) END AS acc, o.hit AS hit0
    FROM os o JOIN pushes w ON w.session_id = o.session_id AND w.channel = o.channel AND w.kind = o.kind AND w.rn = o.rn + 1)),
fired AS (SELECT session_id, t FROM det WHERE alert_level IN ('IMMINENT', 'EARLY_WARNING')),
lat AS (SELECT session_id, t, sum(acc) FILTER (WHERE side = 'R') AS ri, sum(acc) FILTER (WHERE side = 'L') AS le FROM os JOIN fired USING (session_id, t) JOIN {chans} USING (channel) WHERE kind = 'neural' GROUP BY 1, 2),
rk AS (SELECT session_id, t, channel, region, kind, {tenth}(t - hit) / 60.0) AS DOUBLE) AS min_before_alert, row_number() OVER (PARTITION BY session_id, t ORDER BY hit, channel, kind) - 1 AS rank
  FROM os JOIN fired USING (session_id, t) JOIN {chans} USING (channel) WHERE hit IS NOT NULL),
lr AS (SELECT session_id, t, CASE WHEN ri + le > 0 THEN {hundredth}(ri - le) / (ri + le)) AS DOUBLE) ELSE 0.0 END AS lateralisation FROM lat)"""


def onsets() -> str:
    return f"""{onset_ctes()}
SELECT r.session_id, r.t, f.channel AS first_channel, f.region AS first_region, f.kind AS first_kind, lateralisation,
  CAST(r.rank AS INTEGER) AS rank, r.channel, r.region, r.kind, r.min_before_alert FROM rk r JOIN rk f ON f.session_id = r.session_id AND f.t = r.t AND f.rank = 0 JOIN lr l ON l.session_id = r.session_id AND l.t = r.t"""


CALM_ROWS = """SELECT q.session_id, q.t, 'CALIBRATING' AS state, NULL::DOUBLE AS raw_index, NULL::DOUBLE AS idx, NULL::DOUBLE AS slope, NULL::DOUBLE AS eta, quality, 0.0::DOUBLE AS acc, NULL::VARCHAR AS alert_level
  FROM qw q LEFT JOIN fin USING (session_id) WHERE cal_t IS NULL OR q.t <= cal_t"""
ALL_STEPS = f"st AS ({CALM_ROWS} UNION ALL SELECT session_id, t, state, raw_index, level, slope, eta, quality, acc, alert_level FROM det)"


GUARDS = "SELECT rule, CAST(n AS BIGINT) AS n FROM ("
DOCS = "dl AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"

ORACLES = {
    "epoch_qc": f"""WITH {E}, {LOUD}, {STRICT} SELECT epoch_ix, quality_reasons = '' AS accepted, quality_reasons, quality_warnings,
      {r6("CASE WHEN NOT qgap AND qlo >= 0 AND qhi <= 100 THEN qlo END", "sqi_min")}, {r6("CASE WHEN NOT mgap THEN mhi END", "emg_max_db")},
      {r6("max_abs", "max_abs")}, {r6("min_sd", "min_sd")} FROM verdict""",
    "history_qc": f"""WITH {E}, {LOUD}, {judged(45.0, 12.0, 70.0, 15)} SELECT epoch_ix, quality_reasons = '' AS accepted, quality_reasons, quality_warnings, {r6("min_sd", "min_sd")} FROM verdict""",
    "clock_validate": """WITH a AS (SELECT 'E' AS recording_id, vec_id * 32 + i AS ix, (vec_id * 32 + i) / 128.0::DOUBLE AS t, 1 / 128.0::DOUBLE AS st FROM embeddings, range(32) r(i)
      UNION ALL SELECT 'events', event_id, event_id + CASE WHEN value > 100 THEN 0.5 ELSE 0.0 END, 1.0 FROM events),
      b AS (SELECT *, t - lag(t) OVER (PARTITION BY recording_id ORDER BY ix) AS dt FROM a)
      SELECT recording_id, count(*) AS n_rows, count(*) FILTER (WHERE t IS NULL) AS n_bad_time, count(*) FILTER (WHERE abs(dt - st) > 1e-7 + 1e-4 * st) AS n_bad_step FROM b GROUP BY 1""",
    "unit_convert": f"""SELECT event_id, {r6("value * CASE event_type WHEN 'view' THEN 1e6 WHEN 'click' THEN 1e3 WHEN 'error' THEN 1.0 WHEN 'purchase' THEN 1.0 ELSE 1e3 END", "uv")} FROM events""",
    "compact_clock": """WITH h AS (SELECT conv_id, max(length(text)) FILTER (WHERE turn = 0) AS a, max(length(text)) FILTER (WHERE turn = 1) AS b FROM conversations GROUP BY 1)
      SELECT CAST(conv_id AS VARCHAR) AS case_id, turn AS row_ix, CAST(a + turn * b AS DOUBLE) AS t, CAST(length(text) AS DOUBLE) AS value FROM conversations JOIN h USING (conv_id)""",
    "track_check": """SELECT event_type AS tname, count(*) AS n_rows, count(*) FILTER (WHERE value IS NULL) AS n_bad_time, count(*) FILTER (WHERE p >= value) AS n_not_increasing
      FROM (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM (
        SELECT event_type, event_id, value FROM events)) GROUP BY 1""",
    "asof_numeric": f"""WITH {held({t: (t, 'value') for t in ('click', 'error', 'purchase', 'signup', 'view')}, 5.0)} SELECT sample_ix, name AS tname, value FROM held""",
    "epoch_recorded_median": f"""WITH {held({'bis': ('purchase', 'value'), 'sqi': ('view', 'value'), 'emg': ('click', 'value'), 'sef': ('signup', 'value'), 'sr': ('error', 'value')}, 5.0)}
      SELECT sample_ix // 512 AS epoch_ix, {', '.join(r6(f"median(value) FILTER (WHERE name = '{c}')", f"recorded_{c}") for c in ('bis', 'sqi', 'emg', 'sef', 'sr'))} FROM held GROUP BY 1""",
    "epoch_counts": f"""WITH {E}, {LOUD}, {STRICT} SELECT count(*) AS complete_epochs, count(*) FILTER (WHERE quality_reasons = '') AS accepted_epochs,
      count(*) FILTER (WHERE quality_reasons <> '') AS rejected_epochs, (SELECT max(sample_ix) + 1 FROM e) AS samples, (SELECT (max(sample_ix) + 1) % 512 FROM e) AS unused_tail_samples FROM verdict""",
    "welch_psd": f"""WITH {E}, {SPEC} SELECT channel, epoch_ix, k * 128.0::DOUBLE / 256 AS freq_hz, {r6("p", "psd")} FROM psd""",
    "band_powers": f"WITH {E}, {SPEC}, {POWERS} SELECT channel, epoch_ix, {POWER_OUT} FROM pw",
    "relative_power": f"WITH {E}, {SPEC}, {POWERS} SELECT channel, epoch_ix, {', '.join(r6(f'{n} / total', f'{n}_relative_power') for n in BANDS)} FROM pw",
    "delta_alpha_ratio": f"WITH {E}, {SPEC}, {POWERS} SELECT channel, epoch_ix, {r6('CASE WHEN alpha > 1e-12 THEN delta / alpha END', 'delta_alpha_ratio')} FROM pw",
    "sef95": f"WITH {E}, {SPEC}, {SEF} SELECT channel, epoch_ix, {r6('sef', 'sef95_hz')} FROM sef",
    "spectral_entropy": f"WITH {E}, {SPEC}, {ENT} SELECT channel, epoch_ix, {r6('ent', 'spectral_entropy')} FROM ent",
    "notch_power": f"""WITH RECURSIVE {E}, {LISTS}, {zero_phase("nt", "src", notch_section(50.0, 30.0, 128.0), 512)},
      flt AS (SELECT id.channel AS channel, id.epoch_ix AS epoch_ix, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS uv FROM nt),
      {dft("flt", "channel, epoch_ix", 128, 129)}, {POWERS} SELECT channel, epoch_ix, {POWER_OUT} FROM pw""",
    "mean_psd": f"""WITH {E}, {LOUD}, {STRICT}, {SPEC} SELECT channel, k * 128.0::DOUBLE / 256 AS freq_hz, {r6("avg(p)", "mean_psd")} FROM psd JOIN verdict USING (epoch_ix)
      WHERE quality_reasons = '' GROUP BY channel, k""",
    "density_array": f"""WITH {E}, {LOUD}, {STRICT}, {SPEC} SELECT channel, epoch_ix, k * 0.5::DOUBLE AS freq_hz, {r6("k * 0.5::DOUBLE - 0.25", "freq_lo")}, {r6("k * 0.5::DOUBLE + 0.25", "freq_hi")},
      {r6("epoch_ix * 4.0::DOUBLE", "epoch_lo")}, {r6("epoch_ix * 4.0::DOUBLE + 4.0", "epoch_hi")}, {r6("CASE WHEN quality_reasons = '' THEN 10 * log10(greatest(p, 1e-12)) END", "power_db")}
      FROM psd JOIN verdict USING (epoch_ix) WHERE k BETWEEN 1 AND 80""",
    "bicoherence_60s": bicoherence(),
    "plv_alpha": phase_locking(),
    "bipolar_montage": f"""WITH {WEAR}, p AS (SELECT sample_ix, max(uv) FILTER (WHERE channel = 'TP9') AS fp1, max(uv) FILTER (WHERE channel = 'AF8') AS f7, max(uv) FILTER (WHERE channel = 'TP10') AS fpz FROM w GROUP BY 1)
      SELECT 'BISlike_Fp1_minus_ref' AS channel, sample_ix, {r6("fp1 - fpz", "uv")} FROM p UNION ALL SELECT 'BISlike_F7_minus_ref', sample_ix, {r6("f7 - fpz", "uv")} FROM p""",
    "bipolar_montage_mean_reference": f"""WITH {WEAR}, p AS (SELECT sample_ix, max(uv) FILTER (WHERE channel = 'TP9') AS fp1, max(uv) FILTER (WHERE channel = 'AF8') AS f7, max(uv) FILTER (WHERE channel = 'AF7') AS fp2 FROM w GROUP BY 1)
      SELECT 'BISlike_Fp1_minus_ref' AS channel, 'approximate_Fpz_as_mean_Fp1_Fp2' AS reference, sample_ix, {r6("fp1 - (fp1 + fp2) / 2", "uv")} FROM p
      UNION ALL SELECT 'BISlike_F7_minus_ref', 'approximate_Fpz_as_mean_Fp1_Fp2', sample_ix, {r6("f7 - (fp1 + fp2) / 2", "uv")} FROM p""",
    "depth_proxy": f"""WITH {E}, {LOUD}, {STRICT}, {SPEC}, {POWERS}, {SEF}, {ENT} SELECT channel, epoch_ix, {r6("CASE WHEN quality_reasons = '' THEN 100 * (least(1, greatest(0, sef / 30)) + least(1, greatest(0, ent)) + least(1, greatest(0, 1 - delta / total))) / 3 END", "bis_proxy_uncalibrated")}
      FROM pw JOIN sef USING (channel, epoch_ix) JOIN ent USING (channel, epoch_ix) JOIN verdict USING (epoch_ix)""",
    "site_of": """SELECT p_partkey, lower(regexp_split_to_array(regexp_replace('eeg ' || p_name, '^EEG[ _-]*', '', 'i'), '[-_ /.]')[1]) AS site,
      lower(regexp_split_to_array(regexp_replace(trim(' EEG_' || p_type || '-REF'), '^EEG[ _-]*', '', 'i'), '[-_ /.]')[1]) AS type_site FROM part""",
    "region_lookup": f"""WITH c AS (SELECT c_custkey, (['Fp', 'AF', 'F', 'T', 'O', 'X'])[c_nationkey % 6 + 1] || CAST(c_custkey % 9 AS VARCHAR) AS channel FROM customer)
      SELECT c_custkey, channel, {case_map("channel", {k: v[0] for k, v in REGIONS.items()}, "channel")} AS region, {case_map("channel", {k: v[1] for k, v in REGIONS.items()}, "'?'")} AS hemisphere FROM c""",
    "calibration_fit": f"WITH {CALROWS} SELECT subject_id, component, n, CAST(n_problems AS INTEGER) AS n_problems, {r6('duration_s', 'duration_s')}, {r6('mean', 'mean')}, {r6('sd', 'sd')} FROM st JOIN du USING (subject_id) JOIN pb USING (subject_id)",
    "interval_union": f"""WITH o AS (SELECT o_custkey, o_orderkey * 10.0::DOUBLE AS a, o_orderkey * 10.0::DOUBLE + o_totalprice / 10.0 AS b FROM orders),
      p AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM o)
      SELECT o_custkey, {r6("sum(greatest(0, b - greatest(a, coalesce(m, a))))", "duration_s")} FROM p GROUP BY 1""",
    "soi_rdi_score": f"WITH {CALROWS}, {composite()}",
    "event_sessions": EVENT_SESSIONS,
    "robust_baseline": f"WITH {SESSIONS}, {CALIB} SELECT session_id, feature, n, {r6('med', 'med')}, {r6('mad', 'mad')}, {r6('scale', 'scale')} FROM bl",
    "arousal_index": f"""WITH {SESSIONS}, {CALIB}, af AS (UNPIVOT (SELECT s.session_id, s.t, {', '.join('s.' + f for f in FEATS)} FROM ses s JOIN fin USING (session_id) WHERE s.ok AND s.t > cal_t) ON {', '.join(FEATS)} INTO NAME feature VALUE x)
      SELECT session_id, t, {r6(f"sum({case_map('feature', WEIGHTS)} * (x - med) / scale) / sqrt(3.5)", "raw_index")} FROM af JOIN bl USING (session_id, feature) GROUP BY session_id, t""",
    "ewma": f"""WITH RECURSIVE {SESSIONS}, r AS (SELECT session_id, t, x, rn, x AS level FROM cln WHERE rn = 1 UNION ALL
      SELECT c.session_id, c.t, c.x, c.rn, r.level + {ALPHA!r} * (c.x - r.level) FROM r JOIN cln c ON c.session_id = r.session_id AND c.rn = r.rn + 1)
      SELECT session_id, t, {r6("x", "x")}, {r6("level", "level")} FROM r""",
    "cusum": f"""WITH RECURSIVE {SESSIONS}, r AS (SELECT session_id, t, x, rn, greatest(0.0, x - 3.5) AS s FROM cln WHERE rn = 1 UNION ALL
      SELECT c.session_id, c.t, c.x, c.rn, greatest(0.0, r.s + c.x - 3.5) FROM r JOIN cln c ON c.session_id = r.session_id AND c.rn = r.rn + 1)
      SELECT session_id, t, {r6("x", "x")}, {r6("s", "s")} FROM r""",
    "cusum_forget": f"""WITH RECURSIVE {SESSIONS}, r AS (SELECT session_id, t, x, rn, x AS level, CASE WHEN x < 3.4 THEN least(1.0, greatest(0.0, x - 3.5)) ELSE greatest(0.0, x - 3.5) END AS s FROM cln WHERE rn = 1 UNION ALL
      SELECT session_id, t, x, rn, level, CASE WHEN level < 3.4 THEN least(1.0, greatest(0.0, s0 + x - 3.5)) ELSE greatest(0.0, s0 + x - 3.5) END FROM (
        SELECT c.session_id, c.t, c.x, c.rn, r.level + 0.2 * (c.x - r.level) AS level, r.s AS s0 FROM r JOIN cln c ON c.session_id = r.session_id AND c.rn = r.rn + 1))
      SELECT session_id, t, {r6("x", "x")}, {r6("level", "level")}, {r6("s", "s")} FROM r""",
    "ols_trend": f"""WITH {SESSIONS}, f AS (SELECT session_id, t, x, count(*) OVER o AS n, t - min(t) OVER o AS sp, regr_slope(x, t) OVER o AS b FROM cln
      WINDOW o AS (PARTITION BY session_id ORDER BY t RANGE BETWEEN 3000 PRECEDING AND CURRENT ROW))
      SELECT session_id, t, {r6("x", "x")}, {r6("CASE WHEN n >= 10 AND sp >= 60 THEN b * 60 END", "slope_per_min")} FROM f""",
    "ols_trend_long": f"""WITH {SESSIONS}, f AS (SELECT session_id, t, x, count(*) OVER o AS n, t - min(t) OVER o AS sp, regr_slope(x, t) OVER o AS b FROM cln
      WINDOW o AS (PARTITION BY session_id ORDER BY t RANGE BETWEEN 100000 PRECEDING AND CURRENT ROW))
      SELECT session_id, t, {r6("x", "x")}, {r6("CASE WHEN n >= 10 AND sp >= 60 THEN b * 60 END", "slope_per_min")} FROM f""",
    "alert_leads": f"""WITH ev AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS session_id, CAST(event_id AS DOUBLE) AS event_t FROM events WHERE event_type = 'purchase'),
      al AS (SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(event_id AS DOUBLE) AS a, CASE event_type WHEN 'click' THEN 'EARLY_WARNING' WHEN 'view' THEN 'IMMINENT' ELSE 'CLINICAL_RISK' END AS level
        FROM events WHERE event_type IN ('click', 'view', 'signup')),
      lv AS (SELECT * FROM (VALUES ('EARLY_WARNING'), ('IMMINENT'), ('CLINICAL_RISK')) v(level))
      SELECT ev.session_id, event_t, lv.level, count(a) AS n_alerts, {r6("max((event_t - a) / 60)", "first_lead_min")}, {r6("min((event_t - a) / 60)", "last_lead_min")},
        {r6("avg((event_t - a) / 60)", "mean_lead_min")} FROM ev CROSS JOIN lv LEFT JOIN al ON al.session_id = ev.session_id AND al.level = lv.level AND a BETWEEN event_t - 21600 AND event_t
      GROUP BY 1, 2, 3""",
    "quality_fraction": f"""WITH {SESSIONS} SELECT session_id, t, row_number() OVER (PARTITION BY session_id ORDER BY t) - 1 AS ordinal,
      {r6("avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY session_id ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)", "quality")} FROM ses""",
    "bvc_band": f"WITH {OBS}, b AS (SELECT *, {BAND} AS band FROM obs) SELECT session_id, t, score, band, {MULT} AS mult, {OFFS} AS level_offset FROM b",
    "asof_bvc": f"WITH {SESSIONS}, {WITH_BVC} SELECT session_id, t, {MULT} AS mult, {OFFS} AS level_offset, band, score FROM bvc",
    "detector_steps": f"""WITH RECURSIVE {SESSIONS}, {CALIB}, {detector(False)}, {ALL_STEPS} SELECT session_id, t, state, {r6("raw_index", "raw_index")}, {r6("idx", '"index"')}, {r6("slope", "slope_per_min")},
      {r6("eta", "eta_min")}, {r6("quality", "quality")}, {r6("acc", "cusum")}, alert_level FROM st""",
    "detector_steps_bvc": f"""WITH RECURSIVE {SESSIONS}, {CALIB}, {WITH_BVC}, {detector(True)}, {ALL_STEPS} SELECT session_id, t, state, {r6("idx", '"index"')}, {r6("acc", "cusum")}, alert_level FROM st""",
    "kalman_level": f"""WITH RECURSIVE {SESSIONS}, {CALIB}, {kalman()} SELECT session_id, t, {r6("level", '"index"')} FROM k2""",
    "onset_order": f"WITH RECURSIVE {SESSIONS}, {CALIB}, {detector(False)}, {onsets()}",
    "live_window_features": f"""WITH RECURSIVE {LIVE} SELECT window_ix, (window_ix * 256 + 512) / 256.0::DOUBLE AS t, ok, {', '.join(r6(f"CASE WHEN ok THEN avg({f}) END", f) for f in ("alpha_rel", "theta_rel", "beta_alpha_ratio", "muscle_tension"))},
      {r6("CASE WHEN ok THEN max(la) FILTER (WHERE channel = 'AF8') - max(la) FILTER (WHERE channel = 'AF7') END", "frontal_asymmetry")} FROM ch JOIN okw USING (window_ix) GROUP BY window_ix, ok""",
    "live_channel_features": f"""WITH RECURSIVE {LIVE} SELECT window_ix, channel, {r6("alpha_rel", "alpha_rel")}, {r6("beta_alpha_ratio", "beta_alpha_ratio")}, {r6("muscle_tension", "muscle_tension")}
      FROM ch JOIN okw USING (window_ix) WHERE ok""",
    "lead_times": f"WITH {EVAL} SELECT session_id, event_t, {LEAD.format(c='e')} AS early_warning_lead_min, {LEAD.format(c='i')} AS imminent_lead_min FROM hit",
    "false_alarms": f"WITH {EVAL} SELECT session_id, level, alert_t FROM wrong",
    "evaluation": f"""WITH {EVAL}, a AS (SELECT session_id, count(*) AS n_events, count(e) AS detected_early, count(i) AS detected_imminent FROM hit GROUP BY 1),
      b AS (SELECT session_id, count(*) AS n_alerts FROM al GROUP BY 1), c AS (SELECT session_id, count(*) AS false_alarms FROM wrong GROUP BY 1)
      SELECT session_id, coalesce(n_events, 0) AS n_events, coalesce(detected_early, 0) AS detected_early, coalesce(detected_imminent, 0) AS detected_imminent,
        coalesce(n_alerts, 0) AS n_alerts, coalesce(false_alarms, 0) AS false_alarms FROM a FULL JOIN b USING (session_id) FULL JOIN c USING (session_id)""",
    "majority_vote": f"WITH {PRED}, {VOTE} SELECT * FROM vote",
    "confusion": f"WITH {PRED} SELECT truth, pred, count(*) AS n FROM pr GROUP BY 1, 2",
    "classification_metrics": f"WITH {PRED}, {metrics('pr')}",
    "subject_metrics": f"WITH {PRED}, {VOTE}, {metrics('vote')}",
    "manifest_guards": f"""WITH m AS (SELECT CASE lang WHEN 'en' THEN 'ASD' WHEN 'fr' THEN 'PSY' WHEN 'de' THEN 'HC' ELSE 'es' END AS g, CASE WHEN n_chars % 11 = 0 THEN '.' || sha256(text)
      WHEN n_chars % 13 = 0 THEN sha256(text) || '/a' WHEN n_chars % 17 = 0 THEN sha256(text) || chr(92) || 'a' ELSE sha256(text) END AS s FROM documents)
      {GUARDS} SELECT 'unknown_group' AS rule, count(*) FILTER (WHERE g = 'es') AS n FROM m
      UNION ALL SELECT 'path_like_subject_id', count(*) FILTER (WHERE s LIKE '.%' OR s LIKE '%/%' OR contains(s, chr(92))) FROM m
      UNION ALL SELECT 'duplicate_subject_id', count(*) FROM (SELECT s FROM m GROUP BY 1 HAVING count(*) > 1))""",
    "group_guards": f"""WITH {DOCS}, t AS (SELECT source AS s, CASE lang WHEN 'en' THEN 'a' WHEN 'fr' THEN 'p' ELSE 'h' END AS g, lang AS site, quality AS f FROM dl WHERE n_chars > 100)
      {GUARDS} SELECT 'missing_identifier' AS rule, count(*) FILTER (WHERE s IS NULL OR g IS NULL) AS n FROM t UNION ALL SELECT 'unknown_group', 0
      UNION ALL SELECT 'missing_feature', count(*) FILTER (WHERE f IS NULL) FROM t UNION ALL SELECT 'fewer_than_two_groups', CASE WHEN count(DISTINCT g) < 2 THEN 1 ELSE 0 END FROM t
      UNION ALL SELECT 'subject_in_several_groups', count(*) FROM (SELECT s FROM t GROUP BY 1 HAVING count(DISTINCT g) > 1)
      UNION ALL SELECT 'group_with_one_subject', count(*) FROM (SELECT g FROM t GROUP BY 1 HAVING count(DISTINCT s) < 2)
      UNION ALL SELECT 'every_site_single_group', CASE WHEN max(c) = 1 THEN count(*) ELSE 0 END FROM (SELECT site, count(DISTINCT g) AS c FROM t GROUP BY 1))""",
    "state_guards": f"""WITH {DOCS}, t AS (SELECT source AS s, lang AS e, n_chars % 97 AS i, CASE WHEN toxic = 1 THEN 'pre_meltdown' WHEN quality = 1 THEN 'baseline' WHEN quality = 0 THEN 'sensory_loading' END AS l,
        lang <> 'es' AS src, n_chars < 200 AS surg FROM dl)
      {GUARDS} SELECT 'missing_identifier' AS rule, count(*) FILTER (WHERE l IS NULL) AS n FROM t UNION ALL SELECT 'unknown_label', count(*) FILTER (WHERE l IS NULL) FROM t
      UNION ALL SELECT 'unknown_label_source', count(*) FILTER (WHERE NOT src) FROM t UNION ALL SELECT 'surgical_context', count(*) FILTER (WHERE surg) FROM t UNION ALL SELECT 'missing_feature', 0
      UNION ALL SELECT 'fewer_than_two_labels', CASE WHEN count(DISTINCT l) < 2 THEN 1 ELSE 0 END FROM t UNION ALL SELECT 'fewer_than_three_subjects', CASE WHEN count(DISTINCT s) < 3 THEN 1 ELSE 0 END FROM t
      UNION ALL SELECT 'duplicate_epoch', count(*) FROM (SELECT s, e, i FROM t GROUP BY ALL HAVING count(*) > 1)
      UNION ALL SELECT 'label_in_one_subject_only', count(*) FROM (SELECT l FROM t GROUP BY 1 HAVING count(DISTINCT s) < 2))""",
    "union_columns": """SELECT 'customer' AS part, c_custkey AS id, c_acctbal AS acctbal, c_mktsegment FROM customer
      UNION ALL BY NAME SELECT 'supplier' AS part, s_suppkey AS id, s_acctbal AS acctbal, s_nationkey FROM supplier
      UNION ALL BY NAME SELECT 'orders' AS part, o_orderkey AS id, o_orderpriority FROM orders""",
    "set_checks": """SELECT 'only_documents' AS op, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
      UNION ALL SELECT 'only_labels', count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)
      UNION ALL SELECT 'both', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)""",
    "resume_pending": """SELECT doc_id, lang, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'done' ELSE 'pending' END AS status FROM documents""",
    "content_digest": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
}
ORACLES["stream_detector_steps"] = ORACLES["detector_steps"]


def whole_analysis() -> str:
    """Everything of one epoch and channel, NULL where the epoch is rejected."""
    feats = ("CASE WHEN g.quality_reasons = '' THEN {} END").format
    cols = [r6(feats(n), f"{n}_power_uv2") for n in BANDS] + [r6(feats(f"{n} / total"), f"{n}_relative_power") for n in BANDS]
    cols += [r6(feats("total"), "total_power_uv2"), r6(feats("CASE WHEN alpha > 1e-12 THEN delta / alpha END"), "delta_alpha_ratio"),
             r6(feats("sef"), "sef95_hz"), r6(feats("ent"), "spectral_entropy"),
             r6(feats("CASE WHEN h.quality_reasons = '' AND h.quality_warnings = '' THEN b END"), "auto_bicoherence_squared_60s"),
             r6(feats("100 * (least(1, greatest(0, sef / 30)) + least(1, greatest(0, ent)) + least(1, greatest(0, 1 - delta / total))) / 3"), "bis_proxy_uncalibrated")]
    return f"""WITH {E}, {QUIET}, {judged(300.0, 0.05, 80.0, 15)}, {judged(300.0, 0.05, 80.0, 1, "_one")}, {bicoherence_ctes()}, {SPEC}, {POWERS}, {SEF}, {ENT}
SELECT CASE WHEN g.quality_reasons = '' THEN c.channel END AS channel, g.epoch_ix, {r6("g.epoch_ix * 4.0::DOUBLE", "time_s")}, {r6("g.epoch_ix * 4.0::DOUBLE + 4.0", "epoch_end_s")},
  g.quality_reasons = '' AS accepted, g.quality_reasons, g.quality_warnings, 'indeterminate' AS classification, {", ".join(cols)}
FROM verdict_one g JOIN (VALUES ('A'), ('B')) c(channel) ON g.quality_reasons = '' OR c.channel = 'A' JOIN pw ON pw.epoch_ix = g.epoch_ix AND pw.channel = c.channel
JOIN sef ON sef.epoch_ix = g.epoch_ix AND sef.channel = c.channel JOIN ent ON ent.epoch_ix = g.epoch_ix AND ent.channel = c.channel
LEFT JOIN verdict h ON h.epoch_ix = g.epoch_ix LEFT JOIN bic ON bic.epoch_ix = g.epoch_ix AND bic.channel = c.channel"""


ORACLES["analyze_recording"] = whole_analysis()


def messages() -> str:
    """Alert lines with their onset text."""
    from rillwave.model import PROFILES

    def quote(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    texts = PROFILES["meltdown"]
    before, after = texts["early_msg"].split("{when}")
    return f"""WITH RECURSIVE {SESSIONS}, {CALIB}, {WITH_BVC}, {detector(True)}, {onset_ctes()},
later AS (SELECT session_id, t, string_agg(region || ' (' || kind || ')', ', ' ORDER BY rank) AS txt FROM rk WHERE rank BETWEEN 1 AND 3 GROUP BY 1, 2),
ot AS (SELECT f.session_id, f.t, CASE WHEN r.region IS NULL THEN 'Onset map: no channel-level onset detected yet.' ELSE
  'Onset map (sensor level, not a brain focus): earliest change at ' || r.region || ' (' || r.channel || '), ' || format('{{:.1f}}', r.min_before_alert) || ' min before this alert - '
  || CASE r.kind WHEN 'neural' THEN 'cortical (beta/alpha) change' ELSE '30-45 Hz change, most likely muscle tension rather than brain activity' END
  || '; cortical change is ' || CASE WHEN lateralisation > 0.2 THEN 'right-dominant' WHEN lateralisation < -0.2 THEN 'left-dominant' ELSE 'bilateral' END
  || ' (R-L index ' || format('{{:+.2f}}', lateralisation) || ')' || coalesce('; then ' || txt, '') || '.' END AS onset
  FROM fired f LEFT JOIN rk r ON r.session_id = f.session_id AND r.t = f.t AND r.rank = 0 LEFT JOIN lr l ON l.session_id = f.session_id AND l.t = f.t
  LEFT JOIN later x ON x.session_id = f.session_id AND x.t = f.t),
al AS (SELECT d.session_id, d.t, d.alert_level, d.level, coalesce(d.slope, 0.0) AS slope, d.eta, d.band, b.score, o.onset FROM det d JOIN bvc b ON b.session_id = d.session_id AND b.t = d.t
  LEFT JOIN ot o ON o.session_id = d.session_id AND o.t = d.t WHERE d.alert_level IS NOT NULL),
ms AS (SELECT *, CASE WHEN eta IS NULL OR eta > 10 THEN 'escalation may follow within ~10 min' WHEN eta < 1 THEN 'projected to reach the imminent level within a minute'
    ELSE 'projected to reach the imminent level in ~' || format('{{:.0f}}', eta) || ' min' END
  || CASE WHEN band IN ('moderate', 'very_high') THEN ' (sensitivity raised: BVC ' || score || ' = ' || replace(band, '_', ' ') || ' risk)' ELSE '' END AS due FROM al)
SELECT session_id, t, alert_level AS level, '[' || format('{{:02d}}:{{:02d}}', CAST(t AS BIGINT) // 60, CAST(t AS BIGINT) % 60) || '] '
  || CASE alert_level WHEN 'EARLY_WARNING' THEN 'EARLY WARNING' WHEN 'CLINICAL_RISK' THEN 'CLINICAL NOTICE' ELSE alert_level END
  || ' | index ' || format('{{:+.2f}}', level) || ' z | trend ' || format('{{:+.2f}}', slope) || ' z/min'
  || CASE WHEN alert_level <> 'EARLY_WARNING' OR eta IS NULL THEN '' WHEN eta < 1 THEN ' | ETA <1 min' ELSE ' | ETA ~' || format('{{:.0f}}', eta) || ' min' END || chr(10) || '  '
  || CASE alert_level WHEN 'CLINICAL_RISK' THEN 'Clinical notice: BVC score ' || score || ' (>2) = very high risk of violence within 24 h. Agree a preventive, least-restrictive plan; monitoring sensitivity has been raised.'
     WHEN 'IMMINENT' THEN {quote(texts["imminent_msg"])} || chr(10) || '  ' || onset ELSE {quote(before)} || due || {quote(after)} || chr(10) || '  ' || onset END AS text FROM ms"""


ORACLES["alert_messages"] = messages()
ORACLES["alert_outbox"] = f"SELECT session_id, t, level, text, count(*) AS deliveries FROM ({messages()}) GROUP BY ALL"


def live_detector() -> str:
    """The same recursion over the wearable's windows, with the constants of its configuration."""
    rules, calib = detector(False), CALIB
    for old, new in (("acc0 + raw - 0.3) AS acc1, 2.0 * mult AS lim, 1.0 + offs", "acc0 + raw - 0.3) AS acc1, 4.0 * mult AS lim, 2.5 + offs"),
                     ("v >= t - 3000", "v >= t - 20"), ("tt1[1] >= 60 THEN", "tt1[1] >= 10 THEN"), ("slope >= 0.0001", "slope >= 0.05"),
                     ("lv < 0.5", "lv < 1.0"), ("t - i1 >= 100", "t - i1 >= 2"), ("t - e1 >= 100", "t - e1 >= 3")):
        assert old in rules, old
        rules = rules.replace(old, new)
    for old, new in (("rn <= 8 GROUP BY 1 HAVING count(*) = 8", "rn <= 20 GROUP BY 1 HAVING count(*) = 20"), ("greatest(t8, 2000.0)", "greatest(t8, 10.0)")):
        assert old in calib, old
        calib = calib.replace(old, new)
    feats = ", ".join(f"CASE WHEN ok THEN avg({f}) END AS {f}" for f in FEATS[:4])
    return f"""WITH RECURSIVE {LIVE}, ses AS MATERIALIZED (SELECT 'wearable' AS session_id, (window_ix * 256 + 512) / 256.0::DOUBLE AS t, ok, {feats},
  CASE WHEN ok THEN max(la) FILTER (WHERE channel = 'AF8') - max(la) FILTER (WHERE channel = 'AF7') END AS frontal_asymmetry
  FROM ch JOIN okw USING (window_ix) GROUP BY window_ix, ok), {calib}, {rules}, {ALL_STEPS}
SELECT session_id, t, state, {r6("raw_index", "raw_index")}, {r6("idx", '"index"')}, {r6("slope", "slope_per_min")}, {r6("quality", "quality")}, {r6("acc", "cusum")} FROM st"""


ORACLES["live_steps"] = live_detector()
