"""DuckDB SQL with the same results as the relational queries."""

from __future__ import annotations

from outbreak_spark.functions.privacy import PATTERNS
from outbreak_spark.model import POPULATION, PROFILES, SERIAL_INTERVALS, serial_interval
from outbreak_spark.operators.rt import weights_of
from outbreak_spark.plans.queries import WEIGHTS

Z = 1.959963984540054

EV = """d AS (
  SELECT 'r' || CAST(user_id % 5 AS VARCHAR) AS region, event_type AS pathogen, CAST(ts AS DATE) AS date, count(*) AS new_cases,
         count(*) FILTER (event_id % 50 = 0) AS new_deaths, max(1000000 * (user_id % 5 + 1)) AS population
  FROM events GROUP BY 1, 2, 3
), ev AS (
  SELECT *, row_number() OVER w - 1 AS record_index, CAST(sum(new_cases) OVER w AS BIGINT) AS cumulative_cases,
         CAST(sum(new_deaths) OVER w AS BIGINT) AS cumulative_deaths
  FROM d WINDOW w AS (PARTITION BY region, pathogen ORDER BY date)
)"""
SHIP = """f AS (
  SELECT r_name AS region, CAST(l_shipdate AS DATE) AS date, CAST(sum(l_quantity) AS BIGINT) AS new_cases,
         count(*) FILTER (l_returnflag = 'R') AS new_deaths, max(1000000 * (r_regionkey + 1)) AS people
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2
), spine AS (
  SELECT region, people, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT region, max(people) AS people, min(date) AS a, max(date) AS b FROM f GROUP BY 1)
), c AS (
  SELECT s.region, s.date, coalesce(new_cases, 0) AS new_cases, coalesce(new_deaths, 0) AS new_deaths, CAST(s.people AS BIGINT) AS population
  FROM spine s LEFT JOIN f ON s.region = f.region AND s.date = f.date
), ship AS (
  SELECT *, row_number() OVER w - 1 AS record_index, CAST(sum(new_cases) OVER w AS BIGINT) AS cumulative_cases
  FROM c WINDOW w AS (PARTITION BY region ORDER BY date)
)"""
LAM = " + ".join(["0.0::DOUBLE", *(f"coalesce(lag(new_cases, {s}) OVER w, 0) * {w!r}::DOUBLE" for s, w in enumerate(WEIGHTS) if s)])
RT = f"""{EV}, l AS (
  SELECT *, {LAM} AS lam, row_number() OVER w AS pos FROM ev WINDOW w AS (PARTITION BY region, pathogen ORDER BY record_index)
), p AS (
  SELECT *, sum(new_cases) OVER w AS si, sum(lam) OVER w AS sl
  FROM l WINDOW w AS (PARTITION BY region, pathogen ORDER BY record_index ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
), rt AS (
  SELECT *, CASE WHEN sl > 0 THEN 1.0 + si END AS shape, CASE WHEN sl > 0 THEN 1.0 / (1.0 / 5.0 + sl) END AS scale FROM p WHERE pos > 7
)"""
TOTALS = f"""{EV}, t AS (
  SELECT region, pathogen, count(*) AS records, CAST(sum(new_cases) AS BIGINT) AS cases, CAST(sum(new_deaths) AS BIGINT) AS deaths,
         max(population) AS population, min(date) AS first_date, max(date) AS last_date,
         arg_max(date, new_cases * 100000 - record_index) AS peak_date, max(new_cases) AS peak_cases
  FROM ev GROUP BY 1, 2
)"""
MESSY = f"""{EV}, m AS (
  SELECT region, pathogen, record_index,
    CASE WHEN record_index % 17 = 7 THEN '2024-13-01' WHEN record_index % 19 = 8 THEN '' WHEN record_index % 23 = 9 THEN NULL
         WHEN record_index % 29 = 10 THEN '20240115' ELSE CAST(date AS VARCHAR) END AS date,
    CASE WHEN record_index % 11 = 3 THEN -5 WHEN record_index % 13 = 4 THEN NULL WHEN record_index % 7 = 6 THEN new_cases * 10 ELSE new_cases END AS new_cases,
    CASE WHEN record_index % 5 = 4 THEN cumulative_cases - 1000 ELSE cumulative_cases END AS cumulative_cases,
    CASE WHEN record_index % 9 = 2 THEN new_cases + 1 ELSE new_deaths END AS new_deaths, cumulative_deaths,
    CASE WHEN record_index % 12 = 1 THEN NULL WHEN record_index % 12 = 2 THEN 0 ELSE population END AS population
  FROM ev
), y AS (
  SELECT *, CASE WHEN regexp_full_match(date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN TRY_CAST(date AS DATE)
                 WHEN regexp_full_match(date, '\\d{{8}}') THEN CAST(try_strptime(date, '%Y%m%d') AS DATE) END AS day
  FROM m
), x AS (
  SELECT *, lag(new_cases) OVER w AS p_cases, lag(cumulative_cases) OVER w AS p_cum, lag(cumulative_deaths) OVER w AS p_dead, lag(day) OVER w AS p_day,
         coalesce(new_cases, 0) AS nc, coalesce(new_deaths, 0) AS nd, coalesce(cumulative_cases, 0) AS cc, coalesce(cumulative_deaths, 0) AS cd
  FROM y WINDOW w AS (PARTITION BY region, pathogen ORDER BY record_index)
)"""
CHECKS = [
    ("error", "new_cases", "new_cases < 0"), ("error", "cumulative_cases", "cumulative_cases < 0"), ("error", "new_deaths", "new_deaths < 0"), ("error", "cumulative_deaths", "cumulative_deaths < 0"),
    ("warning", "new_deaths", "nd > nc AND nc > 0"), ("warning", "cumulative_deaths", "cd > cc AND cc > 0"), ("error", "population", "population IS NULL OR population <= 0"), ("warning", "cumulative_cases", "cc < nc"),
    ("warning", "date", "day > DATE '2024-01-25'"), ("error", "date", "date <> '' AND day IS NULL"), ("error", "date", "date IS NULL OR date = ''"), ("warning", "new_cases", "p_cases > 0 AND new_cases / p_cases > 3.0"),
    ("warning", "cumulative_cases", "cumulative_cases < p_cum"), ("warning", "cumulative_deaths", "cumulative_deaths < p_dead"), ("warning", "date", "day < p_day"),
]


def _issues(messy: str, first: int = 0) -> str:
    return messy + ", i AS (\n  " + "\n  UNION ALL ".join(f"SELECT region, pathogen, record_index, {k} AS check_seq, '{s}' AS severity, '{f}' AS field FROM x WHERE {t}" for k, (s, f, t) in enumerate(CHECKS) if k >= first) + "\n)"


ISSUES = _issues(MESSY)
_LIST = MESSY.replace("y AS (\n  SELECT *,", "y AS (\n  SELECT * REPLACE (record_index * 1000 + substr(region, 2, 1)::BIGINT * 100 + ascii(pathogen) AS record_index),").replace("FROM y WINDOW w AS (PARTITION BY region, pathogen ORDER", "FROM y WINDOW w AS (ORDER")


def _score(by: str) -> str:
    keys = f"{by}, " if by else ""
    on = "USING (region, pathogen)" if by else "ON true"
    group = f"GROUP BY {by}" if by else ""
    return f"""WITH {ISSUES}, a AS (
  SELECT {keys}count(*) AS total, CAST(sum((date IS NULL)::INT + (region IS NULL)::INT + (pathogen IS NULL)::INT + (new_cases IS NULL)::INT + (population IS NULL)::INT) AS BIGINT) AS missing FROM m {group}
), b AS (
  SELECT {keys}count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
         count(DISTINCT CASE WHEN severity = 'error' THEN region || '/' || pathogen || '/' || record_index END) AS invalid FROM i {group}
), s AS (
  SELECT a.*, coalesce(errors, 0) AS errors, total - coalesce(invalid, 0) AS valid, 1.0 - missing::DOUBLE / (total * 5) AS complete,
         coalesce(warnings, 0) + CASE WHEN 1.0 - missing::DOUBLE / (total * 5) < 0.8 THEN 1 ELSE 0 END AS warnings
  FROM a LEFT JOIN b {on}
), r AS (
  SELECT *, greatest(0.0, least(1.0, 0.5 * valid / total + 0.3 * complete + 0.2 * (1.0 - least(warnings * 0.02, 0.2))))::DOUBLE AS raw FROM s
), q AS (SELECT *, CASE WHEN errors > 0 THEN least(raw, 0.5) ELSE raw END AS score FROM r)
"""


SCORED = "SELECT {keys}total AS total_records, valid AS valid_records, errors, warnings, round(complete, 6) AS completeness, round(score, 6) AS quality_score, score >= 0.7 AS is_acceptable, CASE WHEN score >= 0.7 THEN 'PASS' WHEN score >= 0.5 THEN 'CONDITIONAL' ELSE 'FAIL' END AS gate FROM q"


def _wilson(k: str, n: str) -> str:
    p, c = f"({k} / {n}::DOUBLE)", f"(1 + {Z} * {Z} / {n})"
    root = f"({p} * (1 - {p}) / {n} + {Z} * {Z} / (4.0 * {n} * {n}))"
    mid = f"({p} + {Z} * {Z} / (2.0 * {n}))"
    half = f"{Z} * CASE WHEN {root} >= 0 THEN sqrt({root}) END"
    return f"""CASE WHEN {n} > 0 THEN round({p}, 9) END AS value,
  CASE WHEN {n} > 0 THEN CASE WHEN {root} >= 0 THEN round(greatest(0.0, ({mid} - {half}) / {c}), 9) ELSE 0.0 END END AS lower_ci,
  CASE WHEN {n} > 0 THEN CASE WHEN {root} >= 0 THEN round(least(1.0, ({mid} + {half}) / {c}), 9) ELSE 1.0 END END AS upper_ci"""


def _quantiles(source: str, name: str = "gq") -> str:
    """A table of that name, (a, p, x): quantiles of gamma variables of the shapes a and shares p that `source` lists, by bisection over the
    power series of the distribution function."""
    series = "list_sum(list_transform(range(0, CAST(80 + 12 * sqrt(a) AS BIGINT)), lambda n: exp((a + n) * ln(m) - m - lgamma(a + n + 1))))"
    return f"""{name}b(a, p, lo, hi, k) AS (
  SELECT DISTINCT a::DOUBLE, p::DOUBLE, 0.0::DOUBLE, 2 * a::DOUBLE + 30, 0 FROM ({source}) AS s
  UNION ALL SELECT a, p, CASE WHEN c < p THEN m ELSE lo END, CASE WHEN c < p THEN hi ELSE m END, k + 1
  FROM (SELECT *, {series} AS c FROM (SELECT *, (lo + hi) / 2 AS m FROM {name}b WHERE k < 64) AS h) AS s
), {name} AS (SELECT a, p, (lo + hi) / 2 AS x FROM {name}b WHERE k = 64)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


TEXTS = "x AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations)"
COUNTS = f"{TEXTS}, n AS (\n  " + "\n  UNION ALL ".join(f"SELECT id, '{name}' AS type, len(regexp_extract_all(text, {_quoted('(?i)' + p)})) AS n FROM x" for name, p, _ in PATTERNS) + "\n)"


def _redact(texts: str = TEXTS, keys: str = "id") -> str:
    steps, before = [], "x"
    for k, (name, p, r) in enumerate(PATTERNS):
        had = "[]::VARCHAR[]" if k == 0 else "types"
        steps.append(f"s{k} AS (SELECT {keys}, regexp_replace(text, {_quoted(p)}, '{r}', 'gi') AS text, CASE WHEN regexp_matches(text, {_quoted(p)}, 'i') THEN list_append({had}, '{name}') ELSE {had} END AS types FROM {before})")
        before = f"s{k}"
    return f"WITH {texts}, " + ",\n".join(steps) + f"\nSELECT {keys}, text AS clean, array_to_string(list_sort(types), ',') AS types FROM {before}"


def _lags() -> str:
    cols = [f"lag(new_cases::DOUBLE, {k}) OVER w AS lag_{k}" for k in range(1, 15)]
    for d in (7, 14):
        cols += [f"round({f}, 6) AS rolling_{d}d_{n}" for n, f in (("mean", f"avg(new_cases) OVER w{d}"), ("std", f"coalesce(stddev_samp(new_cases) OVER w{d}, 0.0)"))]
        cols += [f"{n}(new_cases::DOUBLE) OVER w{d} AS rolling_{d}d_{n}" for n in ("min", "max")]
    cols += ["lag(new_cases::DOUBLE, 1) OVER w - lag(new_cases, 2) OVER w AS day_change"]
    cols += ["round(CASE WHEN lag(new_cases, 7) OVER w > 0 THEN lag(new_cases, 1) OVER w / (lag(new_cases, 7) OVER w)::DOUBLE ELSE 1.0 END, 6) AS week_change_ratio"]
    cols += ["(isodow(date) - 1)::INT AS day_of_week", "month(date)::INT AS month", "CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend", "new_cases::DOUBLE AS target", "row_number() OVER w AS pos"]
    part = "PARTITION BY region, pathogen ORDER BY record_index"
    frames = ", ".join(f"w{d} AS ({part} ROWS BETWEEN {d} PRECEDING AND 1 PRECEDING)" for d in (7, 14))
    return f"WITH {EV}, z AS (SELECT region, pathogen, record_index, CAST(date AS VARCHAR) AS date, {', '.join(cols)} FROM ev WINDOW w AS ({part}), {frames}) SELECT * EXCLUDE (pos) FROM z WHERE pos > 14"


GROWTH = f"""{EV}, g AS (
  SELECT region, pathogen, 7.0 - row_number() OVER (PARTITION BY region, pathogen ORDER BY record_index DESC) AS x, new_cases FROM ev
), h AS (SELECT region, pathogen, x, ln(new_cases) AS y FROM g WHERE x >= 0 AND new_cases > 0),
k AS (
  SELECT region, pathogen, count(*) AS n, regr_slope(y, x) AS slope, greatest(0.0, (1 - regr_r2(y, x)) * regr_syy(y, x)) / regr_sxx(y, x) AS rest FROM h GROUP BY 1, 2
), w AS (SELECT *, CASE WHEN n >= 3 THEN slope END AS rate, CASE WHEN n >= 3 THEN sqrt(rest / (n - 2)) END AS se FROM k)"""

PHI = f"""{EV}, ph AS (
  SELECT region, pathogen, record_index AS row, 'lag_' || k AS feature, ((new_cases * k) % 17 - 8)::DOUBLE AS phi FROM ev, (VALUES (1), (2), (3)) AS v(k)
), bk AS (
  SELECT region, pathogen, least(row // (n // 4), 3)::INT AS bucket, feature, avg(abs(phi)) AS importance
  FROM (SELECT *, max(row) OVER (PARTITION BY region, pathogen) + 1 AS n FROM ph) WHERE n >= 20 GROUP BY ALL
)"""
_LABELS = "CASE feature WHEN 'lag_1' THEN 'new cases 1 day earlier' WHEN 'lag_2' THEN 'new cases 2 days earlier' WHEN 'lag_3' THEN 'new cases 3 days earlier' ELSE feature END"



def _canonical(*columns: str) -> str:
    return " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in columns)


_OWN = {n: weights_of(n) for n in SERIAL_INTERVALS}
LAM_OWN = " + ".join(["0.0::DOUBLE", *(f"coalesce(lag(new_cases, {s}) OVER w, 0) * (CASE pathogen WHEN 'Flu' THEN {_OWN['influenza'][s]!r}::DOUBLE WHEN 'measles' THEN {_OWN['measles'][s]!r}::DOUBLE ELSE {_OWN['covid-19'][s]!r}::DOUBLE END)" for s in range(1, len(WEIGHTS)))])
RT_OWN = RT.replace(LAM, LAM_OWN).replace("FROM ev WINDOW", "FROM (SELECT * REPLACE (CASE pathogen WHEN 'click' THEN 'Flu' WHEN 'purchase' THEN 'measles' ELSE pathogen END AS pathogen) FROM ev) WINDOW")

RT_CREDIBLE = f"""{RT}, {_quantiles("SELECT shape AS a, p FROM rt, (VALUES (0.025::DOUBLE), (0.975::DOUBLE)) v(p) WHERE shape IS NOT NULL")}, rc AS (
  SELECT region, pathogen, record_index, date, shape * scale AS rt_mean, l.x * scale AS rt_lower, u.x * scale AS rt_upper, coalesce(sl > 0 AND si + sl < 1.0, false) AS is_prior_dominated
  FROM rt LEFT JOIN gq l ON l.a = shape AND l.p < 0.5 LEFT JOIN gq u ON u.a = shape AND u.p > 0.5
), rp AS (SELECT *, CASE WHEN rt_lower IS NULL THEN 'unknown' WHEN rt_lower > 1 THEN 'growing' WHEN rt_upper < 1 THEN 'declining' ELSE 'stable' END AS phase FROM rc)"""
INCIDENCE = f"""{TOTALS}, {_quantiles("SELECT cases::DOUBLE AS a, 0.025::DOUBLE AS p FROM t WHERE cases > 0 UNION ALL SELECT cases + 1.0, 0.975 FROM t", "gi")}, ic AS (
  SELECT t.*, cases / population::DOUBLE * 100000 AS value, CASE WHEN cases = 0 THEN 0.0 ELSE l.x END * 100000 / population AS lower_ci, u.x * 100000 / population AS upper_ci
  FROM t LEFT JOIN gi l ON l.a = cases AND l.p < 0.5 LEFT JOIN gi u ON u.a = cases + 1 AND u.p > 0.5
)"""


def _interval(k: str, n: str, name: str) -> str:
    return _wilson(k, n).replace(" AS value", f" AS {name}").replace("lower_ci", f"{name}_lower").replace("upper_ci", f"{name}_upper").replace(", 9)", ", 6)")


_ASKED = "(SELECT n_name, (['influenza', 'COVID', 'Measles', 'Flu', 'covid-19', 'ebola'])[n_nationkey % 6 + 1] AS asked FROM nation) AS a"
_TEXTS = "x AS (SELECT 'document' AS kind, coalesce(nullif(source, ''), 'none') AS part, doc_id::VARCHAR AS id, text FROM documents UNION ALL SELECT 'conversation', coalesce(nullif(role, ''), 'none'), conv_id || '-' || turn, text FROM conversations)"
DEIDENTIFIED = _redact(_TEXTS, "kind, part, id").replace("SELECT kind, part, id, text AS clean", "SELECT kind, part, id, length(text)::BIGINT AS n_chars, text AS clean")
SURVEILLANCE = f"""WITH RECURSIVE {RT_CREDIBLE}, {INCIDENCE.removeprefix(EV + ", ")}, {GROWTH.removeprefix(EV + ", ")}, sp AS (
  SELECT region, pathogen, count(*) FILTER (before > 0 AND new_cases / before > 3.0) AS spikes FROM (SELECT *, lag(new_cases) OVER (PARTITION BY region, pathogen ORDER BY record_index) AS before FROM ev) GROUP BY 1, 2
), sc AS (SELECT *, 0.8 + 0.2 * (1.0 - least(spikes * 0.02, 0.2))::DOUBLE AS quality_score FROM sp
), nw AS (SELECT region, pathogen, arg_max(rt_mean, record_index) AS rt_mean, arg_max(rt_lower, record_index) AS rt_lower, arg_max(rt_upper, record_index) AS rt_upper, arg_max(phase, record_index) AS phase FROM rp WHERE rt_mean IS NOT NULL GROUP BY 1, 2
), sm AS (
  SELECT ic.*, {_interval("deaths", "cases", "cfr")}, {_interval("cases", "population", "attack_rate")}, quality_score, CASE WHEN records >= 7 THEN rate END AS growth_rate, CASE WHEN records >= 7 AND rate > 1e-12 THEN ln(2) / rate END AS doubling_time, rt_mean, rt_lower, rt_upper, phase
  FROM ic LEFT JOIN w USING (region, pathogen) LEFT JOIN sc USING (region, pathogen) LEFT JOIN nw USING (region, pathogen)
)
SELECT region, pathogen, CASE WHEN sm.rt_mean < 0.8 THEN 'GREEN' WHEN sm.rt_mean < 1.0 THEN 'YELLOW' WHEN sm.rt_mean < 1.5 THEN 'ORANGE' WHEN sm.rt_mean >= 1.5 THEN 'RED' END AS series_alert_level,
  CASE WHEN quality_score >= 0.7 THEN 'PASS' WHEN quality_score >= 0.5 THEN 'CONDITIONAL' ELSE 'FAIL' END AS series_gate, round(quality_score, 6) AS series_quality_score, cases AS series_cases, deaths AS series_deaths,
  cfr AS series_cfr, cfr_lower AS series_cfr_lower, cfr_upper AS series_cfr_upper, attack_rate AS series_attack_rate, attack_rate_lower AS series_attack_rate_lower, attack_rate_upper AS series_attack_rate_upper,
  round(value, 6) AS series_incidence, round(lower_ci, 6) AS series_incidence_lower, round(upper_ci, 6) AS series_incidence_upper, round(growth_rate, 6) AS series_growth_rate, round(doubling_time, 6) AS series_doubling_time,
  round(sm.rt_mean, 6) AS series_rt_mean, round(sm.rt_lower, 6) AS series_rt_lower, round(sm.rt_upper, 6) AS series_rt_upper, sm.phase AS series_phase, CAST(peak_date AS VARCHAR) AS series_peak_date, peak_cases AS series_peak_cases,
  upper(pathogen[1]) || pathogen[2:] || ' in ' || region || ': ' || format('{{:,}}', cases) || ' cases, ' || format('{{:,}}', deaths) || ' deaths, Rt ' || coalesce(printf('%.2f', sm.rt_mean), 'unknown') || ' (' || coalesce(sm.phase, 'unknown') || ').' AS series_summary,
  d.record_index, CAST(d.date AS VARCHAR) AS date, ev.new_cases, round(d.rt_mean, 6) AS rt_mean, round(d.rt_lower, 6) AS rt_lower, round(d.rt_upper, 6) AS rt_upper, d.phase
FROM sm LEFT JOIN rp d USING (region, pathogen) LEFT JOIN ev USING (region, pathogen, record_index)"""

SQL = {
    "rt_credible": f"WITH RECURSIVE {RT_CREDIBLE} SELECT region, pathogen, CAST(date AS VARCHAR) AS date, round(rt_mean, 6) AS rt_mean, round(rt_lower, 6) AS rt_lower, round(rt_upper, 6) AS rt_upper, phase, is_prior_dominated FROM rp",
    "incidence_interval": f"WITH RECURSIVE {INCIDENCE} SELECT region, pathogen, round(value, 9) AS value, round(lower_ci, 9) AS lower_ci, round(upper_ci, 9) AS upper_ci FROM ic",
    "epi_metrics": f"WITH RECURSIVE {INCIDENCE}, {GROWTH.removeprefix(EV + ', ')} SELECT region, pathogen, cases, round(deaths / cases::DOUBLE, 6) AS value, round(lower_ci, 6) AS lower_ci, round(CASE WHEN records >= 7 THEN rate END, 6) AS growth_rate, round(CASE WHEN records >= 7 AND rate > 1e-12 THEN ln(2) / rate END, 6) AS doubling_time, CAST(first_date AS VARCHAR) AS first_date FROM ic LEFT JOIN w USING (region, pathogen)",
    "rt_by_pathogen": f"WITH {RT_OWN} SELECT region, pathogen, CAST(date AS VARCHAR) AS date, round(lam, 6) AS lam, round(shape * scale, 6) AS rt_mean FROM rt",
    "dataset_contents": f"WITH {EV} SELECT string_agg(DISTINCT region, ',' ORDER BY region) AS regions, string_agg(DISTINCT pathogen, ',' ORDER BY pathogen) AS pathogens FROM ev",
    "first_issues": f"WITH {ISSUES} SELECT row_number() OVER (ORDER BY greatest(check_seq, 10), record_index, region, pathogen, check_seq)::INT AS rank, * FROM i QUALIFY rank <= 20",
    "dataset_issues": _score("region, pathogen").replace("record_index % 12 = 1 THEN", "record_index % 12 = 1 OR (region IN ('r0', 'r1') AND record_index % 3 = 0) THEN") + "SELECT region, pathogen, -1::BIGINT AS record_index, 'warning' AS severity, 'dataset' AS field FROM q WHERE complete < 0.92",
    "changepoint_summary": f"WITH {EV} SELECT region, pathogen, 0.01::DOUBLE AS max_prob, 0::BIGINT AS changepoints, '' AS indices FROM ev GROUP BY 1, 2",
    "surveillance_daily": f"WITH {EV} SELECT region, pathogen, CAST(date AS VARCHAR) AS date, new_cases, new_deaths, population FROM ev",
    "cumulative_counts": f"WITH {EV} SELECT region, pathogen, CAST(date AS VARCHAR) AS date, record_index, cumulative_cases, cumulative_deaths FROM ev",
    "calendar_fill": f"WITH {SHIP} SELECT region, CAST(date AS VARCHAR) AS date, record_index, new_cases, new_deaths, population, cumulative_cases FROM ship",
    "rt_infectiousness": f"WITH {RT} SELECT region, pathogen, CAST(date AS VARCHAR) AS date, new_cases, round(lam, 6) AS lam FROM l",
    "rt_posterior": f"WITH {RT} SELECT region, pathogen, CAST(date AS VARCHAR) AS date, round(shape, 8)::DOUBLE AS shape, round(scale, 8) AS scale, round(shape * scale, 8) AS rt_mean FROM rt",
    "rt_current": f"WITH {RT} SELECT region, pathogen, CAST(arg_max(date, record_index) AS VARCHAR) AS date, round(arg_max(shape * scale, record_index), 6) AS rt_mean, round(min(shape * scale), 6) AS rt_min, round(max(shape * scale), 6) AS rt_max, count(*) AS n_valid FROM rt WHERE sl > 0 GROUP BY 1, 2",
    "alert_levels": f"WITH {RT}, n AS (SELECT region, pathogen, arg_max(shape * scale, record_index) AS r FROM rt WHERE sl > 0 GROUP BY 1, 2) SELECT region, pathogen, CASE WHEN r < 0.8 THEN 'GREEN' WHEN r < 1.0 THEN 'YELLOW' WHEN r < 1.5 THEN 'ORANGE' ELSE 'RED' END AS alert_level FROM n",
    "cfr_wilson": f"WITH {TOTALS} SELECT region, pathogen, cases, deaths, {_wilson('deaths', 'cases')} FROM t",
    "attack_rate": f"WITH {TOTALS} SELECT region, pathogen, cases, population, {_wilson('cases', 'population')} FROM t",
    "wilson_edges": f"""SELECT s_suppkey, deaths, cases, {_wilson("deaths", "cases")} FROM (
  SELECT s_suppkey, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 47) AS deaths, count(*) FILTER (l_quantity > 49) AS cases FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1) AS c""",
    "incidence_rate": f"WITH {TOTALS} SELECT region, pathogen, round(cases / population::DOUBLE * 100000, 6) AS value FROM t",
    "growth_rate": f"WITH {GROWTH} SELECT region, pathogen, n, round(rate, 7) AS growth_rate, round(se, 7) AS se, round(rate - {Z} * se, 7) AS growth_lower, round(rate + {Z} * se, 7) AS growth_upper FROM w",
    "doubling_time": f"WITH {GROWTH} SELECT region, pathogen, round(CASE WHEN rate > 1e-12 THEN ln(2) / rate END, 4) AS doubling_time FROM w",
    "quality_issues": f"WITH {ISSUES} SELECT * FROM i",
    "list_issues": f"WITH {_issues(_LIST, 11)} SELECT * FROM i",
    "quality_score": _score("region, pathogen") + SCORED.format(keys="region, pathogen, "),
    "quality_overall": _score("") + SCORED.format(keys=""),
    "valid_records": f"WITH {ISSUES} SELECT region, pathogen, record_index, date, new_cases, population FROM m ANTI JOIN (SELECT * FROM i WHERE severity = 'error') e USING (region, pathogen, record_index)",
    "spikes": f"WITH {MESSY} SELECT region, pathogen, record_index, round(new_cases / p_cases::DOUBLE, 2) AS fold FROM x WHERE p_cases > 0 AND new_cases / p_cases > 3.0",
    "monotonicity": f"WITH {MESSY} SELECT region, pathogen, record_index, 'cumulative_cases' AS field, cumulative_cases AS value FROM x WHERE cumulative_cases < p_cum UNION ALL SELECT region, pathogen, record_index, 'cumulative_deaths', cumulative_deaths FROM x WHERE cumulative_deaths < p_dead",
    "completeness": _score("region, pathogen") + "SELECT region, pathogen, missing, round(complete, 6) AS completeness FROM q",
    "pii_detect_counts": f"WITH {COUNTS} SELECT id, type, n FROM n WHERE n > 0",
    "pii_redact_docs": _redact(),
    "pii_types": f"WITH {COUNTS} SELECT type, CAST(sum(n) AS BIGINT) AS matches, count(*) AS texts FROM n WHERE n > 0 GROUP BY 1",
    "pii_audit": f"WITH {COUNTS} SELECT count(*) > 0 AS pii_detected, string_agg(DISTINCT type, ',' ORDER BY type) AS pii_types_found, CAST(sum(n) AS BIGINT) AS matches FROM n WHERE n > 0",
    "redaction_report": _redact().replace("\nSELECT id, text AS clean", ", done AS (SELECT id, text AS clean", 1) + f"""), h AS (SELECT sha256({_canonical("id", "text")}) AS h FROM x), q AS (
  SELECT count(*) AS n, {", ".join(f"coalesce(sum(('0x' || substr(h, {1 + 15 * k}, 15))::BIGINT), 0)::VARCHAR AS s{k}" for k in range(4))} FROM h
), t AS (SELECT unnest(string_split(types, ',')) AS type FROM done WHERE types <> '')
SELECT n AS records, (SELECT count(*) > 0 FROM t) AS pii_detected, (SELECT coalesce(string_agg(DISTINCT type, ',' ORDER BY type), '') FROM t) AS pii_types_found, (SELECT count(*) FROM t) AS items_redacted,
  sha256(n || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3) AS data_hash FROM q""",
    "dataset_hash": f"""WITH {EV}, a AS (
  SELECT sha256({_canonical("region", "pathogen", "date", "new_cases", "new_deaths")}) AS h, sha256({_canonical("region", "pathogen", "record_index")}) AS k FROM ev
), p AS (SELECT substring(k, 1, 4) AS p, substring(k, 1, 8) AS q, sha256(string_agg(k || h, '' ORDER BY k, h)) AS h, count(*) AS n FROM a GROUP BY 1, 2
), o AS (SELECT p, sha256(string_agg(h, '' ORDER BY q)) AS h, sum(n) AS n FROM p GROUP BY 1)
SELECT sha256(string_agg(h, '' ORDER BY p)) AS data_hash, CAST(sum(n) AS BIGINT) AS records FROM o""",
    "lag_features": _lags(),
    "rolling_curve": f"WITH {EV}, z AS (SELECT region, pathogen, CAST(date AS VARCHAR) AS date, new_cases, round(avg(new_cases) OVER (PARTITION BY region, pathogen ORDER BY record_index ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS mean, record_index FROM ev) SELECT * EXCLUDE (record_index) FROM z WHERE record_index >= 6",
    "top_days": f"WITH {EV}, z AS (SELECT region, pathogen, CAST(date AS VARCHAR) AS date, new_cases, row_number() OVER (PARTITION BY region, pathogen ORDER BY new_cases DESC, record_index)::INT AS rank FROM ev) SELECT * FROM z WHERE rank <= 5",
    "dataset_summary": f"WITH {TOTALS} SELECT region, pathogen, records, cases, deaths, population, CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date, CAST(peak_date AS VARCHAR) AS peak_date, peak_cases FROM t",
    "peak_day": f"WITH {SHIP} SELECT region, count(*) AS records, CAST(sum(new_cases) AS BIGINT) AS cases, CAST(arg_max(date, new_cases * 1000000 - record_index) AS VARCHAR) AS peak_date, max(new_cases) AS peak_cases FROM ship GROUP BY 1",
    "epiweek_dates": """WITH w AS (SELECT DISTINCT year(o_orderdate) AS y, (dayofyear(o_orderdate) - 1) // 7 + 1 AS w FROM orders), f AS (SELECT *, make_date(y, 1, 4) AS f FROM w)
SELECT y * 100 + w AS epiweek, CAST(f - (dayofweek(f))::INT + ((w - 1) * 7 + 6)::INT AS VARCHAR) AS date, CAST(f - (isodow(f))::INT + ((w - 1) * 7 + 6)::INT AS VARCHAR) AS legacy_date FROM f""",
    "fluview_records": """WITH e AS (SELECT CASE user_id % 5 WHEN 0 THEN 'nat' ELSE 'hhs' || user_id % 5 END AS region, year(ts) AS y, (dayofyear(ts) - 1) // 7 + 1 AS w, event_type FROM events),
g AS (SELECT region, y, w, make_date(y, 1, 4) AS f, count(*) FILTER (event_type = 'click') AS n FROM e GROUP BY 1, 2, 3)
SELECT row_number() OVER (PARTITION BY region ORDER BY y, w) - 1 AS record_index, CAST(f - (dayofweek(f))::INT + ((w - 1) * 7 + 6)::INT AS VARCHAR) AS date, region, 'influenza' AS pathogen,
  CASE WHEN (y * 100 + w) % 2 = 1 THEN n ELSE 0 END AS new_cases, CASE region WHEN 'nat' THEN 330000000 ELSE 33000000 END::BIGINT AS population, 'cdc_fluview' AS source FROM g""",
    "population_join": "WITH p(region, population) AS (VALUES " + ", ".join(f"('{r}', {n}::BIGINT)" for r, n in POPULATION.items()) + "), a AS (SELECT n_name, 'HHS' || CAST(n_nationkey % 12 AS VARCHAR) AS asked FROM nation) SELECT n_name, asked, population FROM a LEFT JOIN p ON lower(asked) = p.region",
    "pathogen_profiles": "WITH v(name, pathogen, r0, latent, infectious, cfr, population) AS (VALUES " + ", ".join(f"('{a}', '{n}', {r!r}::DOUBLE, {x!r}::DOUBLE, {i!r}::DOUBLE, {c!r}::DOUBLE, {p}::BIGINT)" for a, n in [*((n, n) for n in PROFILES), ("covid", "covid-19"), ("flu", "influenza")] for r, x, i, c, p in [PROFILES[n]]) + f") SELECT n_name, asked, pathogen, r0, cfr, population, round(r0 * (1 / infectious), 9) AS beta, round(1 / latent, 9) AS sigma, round(1 / infectious, 9) AS gamma FROM {_ASKED} LEFT JOIN v ON lower(asked) = name",
    "serial_interval_pmf": "WITH v(pathogen, day, weight) AS (VALUES " + ", ".join(f"('{n}', {d}, {w!r}::DOUBLE)" for n, si in SERIAL_INTERVALS.items() for d, w in enumerate(serial_interval(*si))) + f") SELECT n_name, pathogen, day, round(weight, 9) AS weight FROM {_ASKED} JOIN v ON pathogen = CASE lower(asked) WHEN 'flu' THEN 'influenza' WHEN 'influenza' THEN 'influenza' WHEN 'measles' THEN 'measles' ELSE 'covid-19' END",
    "changepoint_prob": f"WITH {EV} SELECT region, pathogen, record_index, round(1.0 / 100, 6)::DOUBLE AS changepoint_prob, false AS is_changepoint FROM ev",
    "ensemble_weights": f"WITH {TOTALS}, m AS (SELECT region, pathogen, 'm1' AS model, (cases % 7)::DOUBLE AS rmse FROM t UNION ALL SELECT region, pathogen, 'm2', (cases % 5 + 0.5)::DOUBLE FROM t UNION ALL SELECT region, pathogen, 'm3', NULL FROM t), w AS (SELECT *, 1.0 / CASE WHEN rmse > 0 THEN rmse ELSE 1e6 END AS inv FROM m) SELECT region, pathogen, model, round(rmse, 9) AS rmse, round(inv / sum(inv) OVER (PARTITION BY region, pathogen), 9) AS weight FROM w",
    "shap_time_buckets": f"WITH {PHI} SELECT region, pathogen, bucket, feature, round(importance, 6) AS importance FROM bk",
    "top_drivers": f"WITH {PHI}, z AS (SELECT region, pathogen, feature, avg(abs(phi)) AS importance FROM ph GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY region, pathogen ORDER BY importance DESC, feature)::INT AS rank FROM z) SELECT region, pathogen, feature, round(importance, 6) AS importance, rank, {_LABELS} AS label FROM r WHERE rank <= 2",
    "driver_trends": f"WITH {PHI} SELECT region, pathogen, feature, CASE WHEN arg_max(importance, bucket) > arg_min(importance, bucket) THEN 'increasing' ELSE 'decreasing' END AS trend FROM bk WHERE bucket >= 1 GROUP BY 1, 2, 3",
}
