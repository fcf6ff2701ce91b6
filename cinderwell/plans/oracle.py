"""DuckDB twins of the registered queries (the driver's correctness gate).

The SQL is written independently of the Spark plans: the perimeters are the
closed-form L-shape predicate rather than a ring parity test, the pivot is
FILTERed ``arg_min``, the event study is a scenario cross join, and so on.
Tables ``lineitem supplier nation ...`` are views registered by the driver.
"""

from __future__ import annotations

from cinderwell.sources.bindings import BINDING_ANALYTES, BINDING_UNITS, LARGE_FIRE_ACRES

R = 6  # digits every hash-compared float is rounded to (both sides)
A = sorted(BINDING_ANALYTES)


def qi(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def rnd(expr: str, digits: int = R) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits})"


def _lon(k):
    return f"(-124.0 + CAST(({k} * 7919) % 1000 AS DOUBLE) / 100.0)"


def _lat(k):
    return f"(32.0 + CAST(({k} * 104729) % 1000 AS DOUBLE) / 100.0)"


def readings_cte() -> str:
    unit = " ".join(f"WHEN l.l_returnflag = '{f}' THEN '{u}'" for f, u in BINDING_UNITS.items())
    return f"""readings AS (
  SELECT CAST(l.l_suppkey AS VARCHAR) AS StationCode,
         CAST(l.l_shipdate AS DATE) AS SampleDate,
         s.s_name AS StationName,
         {_lat('s.s_suppkey')} AS TargetLatitude,
         {_lon('s.s_suppkey')} AS TargetLongitude,
         CAST(s.s_nationkey AS INTEGER) AS Region,
         l.l_returnflag || ', ' || l.l_linestatus AS Analyte,
         CASE WHEN isnan(l.l_quantity) THEN NULL ELSE l.l_quantity END AS Result,
         CASE {unit} END AS Unit,
         l.l_orderkey * 10 + l.l_linenumber AS ord
  FROM lineitem l LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey)"""


def master_ctes() -> str:
    piv = ",\n    ".join(f"arg_min(Result, ord) FILTER (WHERE Analyte = '{a}') AS {qi(a)}" for a in A)
    inlist = ", ".join(f"'{a}'" for a in A)
    cols = ", ".join(f"w.{qi(a)}" for a in A)
    return f"""{readings_cte()},
wide AS (
  SELECT StationCode, SampleDate,
    {piv}
  FROM readings
  WHERE StationCode IS NOT NULL AND SampleDate IS NOT NULL AND Result IS NOT NULL
    AND Analyte IN ({inlist})
  GROUP BY StationCode, SampleDate),
meta AS (
  SELECT DISTINCT StationCode, SampleDate, StationName, TargetLatitude, TargetLongitude, Region
  FROM readings),
master AS (
  SELECT w.StationCode, m.StationName, m.TargetLatitude, m.TargetLongitude, m.Region,
         w.SampleDate, {cols}
  FROM wide w LEFT JOIN meta m ON w.StationCode = m.StationCode AND w.SampleDate = m.SampleDate)"""


def fires_cte() -> str:
    return """fires AS (
  SELECT CAST(n_nationkey AS BIGINT) AS fire_id, n_name AS FIRE_NAME,
         CAST(-124.0 + 2 * (n_nationkey % 5) AS DOUBLE) AS x0,
         CAST(32.0 + 2 * (n_nationkey // 5) AS DOUBLE) AS y0,
         CAST(DATE '1995-06-01' + 90 * n_nationkey AS TIMESTAMP) AS ALARM_DATE,
         CAST(DATE '1995-06-01' + 90 * n_nationkey + 30 AS TIMESTAMP) AS CONT_DATE,
         CASE WHEN n_nationkey % 7 = 0 THEN NULL
              ELSE CAST(1000 * ((n_nationkey * n_nationkey) % 150) AS DOUBLE) END AS GIS_ACRES
  FROM nation)"""


def inside(lon: str, lat: str, f: str = "f") -> str:
    """Strictly inside the L-shape (square 2.5 minus its upper-right 1.0)."""
    return (f"({lon} > {f}.x0 AND {lon} < {f}.x0 + 2.5 AND {lat} > {f}.y0 AND {lat} < {f}.y0 + 2.5 "
            f"AND NOT ({lon} >= {f}.x0 + 1.5 AND {lat} >= {f}.y0 + 1.5))")


DAYS = ("CAST(floor((epoch_us(CAST(m.SampleDate AS TIMESTAMP)) - epoch_us(f.ALARM_DATE)) "
        "/ 86400000000.0) AS INTEGER)")


def joined_ctes() -> str:
    return f"""{master_ctes()},
{fires_cte()},
joined AS (
  SELECT m.*, CAST(year(m.SampleDate) AS INTEGER) AS SampleYear, f.fire_id AS index_right,
         f.FIRE_NAME, f.ALARM_DATE, CAST(year(f.ALARM_DATE) AS INTEGER) AS FireYear, f.GIS_ACRES,
         f.CONT_DATE, {DAYS} AS days_since_fire
  FROM master m LEFT JOIN fires f ON {inside('m.TargetLongitude', 'm.TargetLatitude')})"""


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


MASTER_COLS = ["StationCode", "StationName", "TargetLatitude", "TargetLongitude", "Region", "SampleDate"]
JOINED_TAIL = ["SampleYear", "index_right", "FIRE_NAME", "ALARM_DATE", "FireYear", "GIS_ACRES"]


def joined_select(extra=()) -> str:
    cols = [qi(c) for c in MASTER_COLS + A + JOINED_TAIL] + list(extra)
    return ", ".join(cols)


# --------------------------------------------------------------------------
# Event study
# --------------------------------------------------------------------------
SCEN_ALL = [("1yr_all", 365, "0.0"), ("5yr_all", 1825, "0.0"),
            ("1yr_large", 365, str(LARGE_FIRE_ACRES)), ("5yr_large", 1825, str(LARGE_FIRE_ACRES))]
SCEN_S1 = [("1yr", 365, "NULL")]


def study_ctes(scenarios) -> str:
    vals = ", ".join(f"('{n}', {d}, CAST({m} AS DOUBLE))" for n, d, m in scenarios)
    aggs = []
    for i, a in enumerate(A):
        c = qi(a)
        aggs += [f"avg(CASE WHEN d < 0 THEN {c} END) AS b{i}",
                 f"avg(CASE WHEN d >= 0 AND d <= after_days THEN {c} END) AS a{i}",
                 f"count(CASE WHEN d < 0 THEN {c} END) AS nb{i}",
                 f"count(CASE WHEN d >= 0 AND d <= after_days THEN {c} END) AS na{i}"]
    cells = []
    for i, a in enumerate(A):
        ok = f"nb{i} > 0 AND na{i} > 0"
        cells.append(f"""SELECT scenario, Fire, GIS_Acres, n_before, n_after, '{a}' AS Analyte,
         CAST(nb{i} AS BIGINT) AS n_b, CAST(na{i} AS BIGINT) AS n_a,
         CASE WHEN {ok} THEN b{i} END AS "before",
         CASE WHEN {ok} THEN a{i} END AS "after",
         CASE WHEN {ok} THEN a{i} - b{i} END AS change
  FROM per_fire""")
    cells_sql = "\n  UNION ALL ".join(cells)
    return f"""{joined_ctes()},
scen AS (SELECT * FROM (VALUES {vals}) s(scenario, after_days, min_acres)),
base AS (
  SELECT s.scenario, s.after_days, j.FIRE_NAME AS Fire, j.days_since_fire AS d, j.GIS_ACRES AS acres,
         {{'a': j.StationCode, 'b': j.SampleDate, 'c': j.StationName, 'd': j.TargetLatitude,
          'e': j.TargetLongitude, 'f': j.Region, 'g': j.index_right}} AS o,
         {", ".join('j.' + qi(a) for a in A)}
  FROM joined j CROSS JOIN scen s
  WHERE j.FIRE_NAME IS NOT NULL AND j.days_since_fire IS NOT NULL
    AND (s.min_acres IS NULL OR j.GIS_ACRES >= s.min_acres)),
per_fire AS (
  SELECT scenario, Fire,
         CAST(count_if(d < 0) AS BIGINT) AS n_before,
         CAST(count_if(d >= 0 AND d <= after_days) AS BIGINT) AS n_after,
         arg_min_null(acres, o) AS GIS_Acres,
         {", ".join(aggs)}
  FROM base GROUP BY scenario, after_days, Fire
  HAVING count_if(d < 0) > 0 AND count_if(d >= 0 AND d <= after_days) > 0),
results AS (
  {cells_sql})"""


def fire_results_wide_sql(scenarios, scenario: str) -> str:
    cols = []
    for a in A:
        for part in ("before", "after", "change"):
            cols.append(f"{rnd(f'max(CASE WHEN Analyte = {chr(39)}{a}{chr(39)} THEN {qi(part)} END)')} AS {qi(a + '_' + part)}")
    return with_(study_ctes(scenarios), f"""SELECT Fire, GIS_Acres, n_before, n_after,
  {", ".join(cols)}
FROM results WHERE scenario = '{scenario}'
GROUP BY scenario, Fire, GIS_Acres, n_before, n_after""")


def t_p_sql(t: str, v: str) -> str:
    """Two-sided Student-t p-value, same finite series as the Spark side."""
    t, v = f"({t})", f"({v})"
    th = f"atan(abs({t}) / sqrt(CAST({v} AS DOUBLE)))"
    c2 = f"(cos({th}) * cos({th}))"
    def series(m, odd):
        ratio = "(2.0 * k) / (2.0 * k + 1.0)" if odd else "(2.0 * k - 1.0) / (2.0 * k)"
        return (f"list_reduce(range(1, GREATEST({m}, 0) + 1), lambda acc, k: "
                f"{{'term': acc.term * {ratio} * {c2}, 'total': acc.total + acc.term * {ratio} * {c2}}}, "
                f"{{'term': 1.0::DOUBLE, 'total': 1.0::DOUBLE}}).total")
    odd_a = (f"CASE WHEN {v} = 1 THEN 2.0 * {th} / pi() ELSE 2.0 / pi() * ({th} + sin({th}) * cos({th}) * "
             f"{series(f'CAST(floor(({v} - 3) / 2) AS INTEGER)', True)}) END")
    even_a = f"sin({th}) * {series(f'CAST(floor(({v} - 2) / 2) AS INTEGER)', False)}"
    a = f"CASE WHEN {v} % 2 = 1 THEN {odd_a} ELSE {even_a} END"
    return f"GREATEST(0.0, LEAST(1.0, 1.0 - ({a})))"


def ttest_ctes(scenarios) -> str:
    return f"""{study_ctes(scenarios)},
tt AS (
  SELECT scenario, Analyte, CAST(count(*) AS BIGINT) AS n_pairs,
         avg("before" - "after") AS mean_diff, stddev_samp("before" - "after") AS sd_diff,
         avg(change) AS mean_change, avg("before") AS mean_before, avg("after") AS mean_after
  FROM results WHERE "before" IS NOT NULL AND "after" IS NOT NULL
  GROUP BY scenario, Analyte HAVING count(*) >= 2),
tt2 AS (
  SELECT *, CASE WHEN sd_diff > 0 THEN mean_diff / (sd_diff / sqrt(CAST(n_pairs AS DOUBLE))) END AS t_stat
  FROM tt),
tt3 AS (
  SELECT *, CASE WHEN sd_diff > 0 THEN {t_p_sql('t_stat', 'n_pairs - 1')}
                 WHEN mean_diff = 0 THEN NULL ELSE 0.0 END AS p_value
  FROM tt2)"""


# --------------------------------------------------------------------------
# Query -> SQL
# --------------------------------------------------------------------------
def _r(c: str) -> str:
    return f"{rnd(qi(c))} AS {qi(c)}"


MASTER_ROUNDED = ", ".join([qi("StationCode"), qi("StationName"), _r("TargetLatitude"),
                            _r("TargetLongitude"), qi("Region"), qi("SampleDate")] + [_r(a) for a in A])
JOINED_ROUNDED = MASTER_ROUNDED + ", " + ", ".join(
    [qi("SampleYear"), qi("index_right"), qi("FIRE_NAME"), qi("ALARM_DATE"), qi("FireYear"), _r("GIS_ACRES")])
ONE_MONTH = "FROM joined WHERE FIRE_NAME IS NOT NULL AND days_since_fire BETWEEN 0 AND 30"


def _wide_scenario(name):
    return fire_results_wide_sql(SCEN_ALL, name)


SQL = {
    "units_reference": with_(readings_cte(), """SELECT Analyte, arg_min(Unit, {'a': StationCode, 'b': SampleDate, 'c': ord}) AS Unit
FROM readings WHERE Analyte IS NOT NULL GROUP BY Analyte"""),
    "analytes_found": with_(readings_cte(), "SELECT DISTINCT Analyte FROM readings WHERE Analyte IS NOT NULL"),
    "master_wide": with_(master_ctes(), f"SELECT {MASTER_ROUNDED} FROM master"),
    "surrogate_id": with_(master_ctes(), f"""SELECT CAST(row_number() OVER (ORDER BY StationCode NULLS FIRST,
  SampleDate NULLS FIRST, StationName NULLS FIRST, TargetLatitude NULLS FIRST, TargetLongitude NULLS FIRST,
  Region NULLS FIRST) AS BIGINT) AS WaterQualityID, {MASTER_ROUNDED} FROM master"""),
    "file_head_n": with_(readings_cte(), f"""SELECT StationCode, SampleDate, StationName, {_r('TargetLatitude')},
  {_r('TargetLongitude')}, Region, Analyte, {_r('Result')}, Unit, ord
FROM (SELECT *, row_number() OVER (PARTITION BY Analyte ORDER BY ord) AS rn FROM readings) t
WHERE rn <= 1000"""),
    "union_by_name": with_(readings_cte(), f"""SELECT StationCode, SampleDate, Analyte, {_r('Result')}, CAST(NULL AS VARCHAR) AS Unit
FROM readings WHERE Analyte LIKE 'A%'
UNION ALL
SELECT StationCode, SampleDate, Analyte, CAST(NULL AS DOUBLE) AS Result, Unit
FROM readings WHERE NOT (Analyte LIKE 'A%')"""),
    "station_fire_join": with_(fires_cte(), f"""SELECT s.s_suppkey AS station_key, {rnd(_lon('s.s_suppkey'))} AS TargetLongitude,
  {rnd(_lat('s.s_suppkey'))} AS TargetLatitude, f.fire_id AS index_right, f.FIRE_NAME
FROM supplier s LEFT JOIN fires f ON {inside(_lon('s.s_suppkey'), _lat('s.s_suppkey'))}"""),
    "same_year_matches": with_(joined_ctes(), f"""SELECT {JOINED_ROUNDED} FROM joined
WHERE FIRE_NAME IS NOT NULL AND SampleYear = FireYear"""),
    "days_since_event": with_(joined_ctes(), """SELECT StationCode, SampleDate, index_right, FIRE_NAME, ALARM_DATE,
  days_since_fire FROM joined WHERE FIRE_NAME IS NOT NULL"""),
    "impacted_one_month": with_(joined_ctes(), f"SELECT {JOINED_ROUNDED}, days_since_fire {ONE_MONTH}"),
    "impacted_counts": with_(joined_ctes(), f"SELECT FIRE_NAME, CAST(count(*) AS BIGINT) AS count {ONE_MONTH} GROUP BY FIRE_NAME"),
    "impacted_range": with_(joined_ctes(), f"SELECT min(SampleDate) AS min_SampleDate, max(SampleDate) AS max_SampleDate {ONE_MONTH}"),
    "impacted_preview": with_(joined_ctes(), f"""SELECT StationName, SampleDate, FIRE_NAME, {_r('GIS_ACRES')}, {_r(A[0])}
{ONE_MONTH} ORDER BY StationCode, SampleDate, index_right LIMIT 10"""),
    "impacted_wkt": with_(joined_ctes(), f"""SELECT {MASTER_ROUNDED},
  'POINT (' || CAST(TargetLongitude AS VARCHAR) || ' ' || CAST(TargetLatitude AS VARCHAR) || ')' AS geometry,
  index_right, FIRE_NAME, ALARM_DATE, CONT_DATE, {_r('GIS_ACRES')}, days_since_fire {ONE_MONTH}"""),
    "fire_paired_1yr": fire_results_wide_sql(SCEN_S1, "1yr"),
    "fire_results_1yr_all": _wide_scenario("1yr_all"),
    "fire_results_5yr_all": _wide_scenario("5yr_all"),
    "fire_results_1yr_large": _wide_scenario("1yr_large"),
    "fire_results_5yr_large": _wide_scenario("5yr_large"),
    "fire_results_long": with_(study_ctes(SCEN_ALL), f"""SELECT scenario, Fire, {_r('GIS_Acres')}, n_before, n_after,
  Analyte, n_b, n_a, {_r('before')}, {_r('after')}, {_r('change')} FROM results"""),
    "mean_change": with_(study_ctes(SCEN_ALL), f"""SELECT scenario, Analyte, {rnd('avg(change)')} AS mean_change,
  CAST(count(change) AS BIGINT) AS n_fires,
  CASE WHEN avg(change) > 0 THEN '↑ increased' ELSE '↓ decreased' END AS direction
FROM results WHERE change IS NOT NULL GROUP BY scenario, Analyte"""),
    "paired_ttest": with_(ttest_ctes(SCEN_ALL), f"""SELECT scenario, Analyte, n_pairs, {_r('mean_diff')}, {_r('sd_diff')},
  {_r('t_stat')}, {_r('p_value')}, COALESCE(p_value < 0.05, false) AS significant FROM tt3"""),
    "scenario_summary": with_(ttest_ctes(SCEN_ALL), f"""SELECT scenario, Analyte, {_r('mean_change')}, {_r('p_value')},
  n_pairs AS n_fires, CASE WHEN mean_change > 0 THEN '↑' ELSE '↓' END AS direction FROM tt3"""),
    "scenario_matrix": with_(study_ctes(SCEN_ALL), f"""SELECT g.scenario, g.Analyte, {rnd('COALESCE(m.mean_change, 0.0)')} AS mean_change,
  CASE WHEN COALESCE(m.mean_change, 0.0) >= 0 THEN 'up' ELSE 'down' END AS direction
FROM (SELECT s.scenario, a.Analyte FROM (VALUES {", ".join(f"('{n}')" for n, _, _ in SCEN_ALL)}) s(scenario)
      CROSS JOIN (VALUES {", ".join(f"('{a}')" for a in A)}) a(Analyte)) g
LEFT JOIN (SELECT scenario, Analyte, avg(change) AS mean_change FROM results WHERE change IS NOT NULL
           GROUP BY scenario, Analyte) m ON g.scenario = m.scenario AND g.Analyte = m.Analyte"""),
    "paired_means": with_(study_ctes(SCEN_S1), f"""SELECT scenario, Analyte, {rnd('avg("before")')} AS mean_before,
  {rnd('avg("after")')} AS mean_after, CAST(count(*) AS BIGINT) AS n_pairs
FROM results WHERE "before" IS NOT NULL AND "after" IS NOT NULL GROUP BY scenario, Analyte"""),
    "short_labels": with_(readings_cte(), """SELECT DISTINCT Analyte, split_part(Analyte, ',', 1) AS short_label
FROM readings WHERE Analyte IS NOT NULL"""),
}


# --------------------------------------------------------------------------
# Stage C: model preparation and metrics
# --------------------------------------------------------------------------
KEYS = ["StationCode", "SampleDate", "index_right"]
KEYS_SQL = ", ".join(KEYS)


def model_ctes() -> str:
    return f"""{joined_ctes()},
model AS (
  SELECT *, CAST(days_since_fire >= 0 AS INTEGER) AS post_fire, ln(1 + GIS_ACRES) AS log_acres,
         CAST(month(SampleDate) AS INTEGER) AS month,
         CAST(floor((month(SampleDate) % 12) / 3) AS INTEGER) AS season_num
  FROM joined WHERE days_since_fire BETWEEN -1825 AND 1825)"""


def clf_ctes() -> str:
    present = " + ".join(f"(CASE WHEN {qi(a)} IS NOT NULL THEN 1 ELSE 0 END)" for a in A)
    meds = ", ".join(f"median({qi(a)}) AS m{i}" for i, a in enumerate(A))
    imp = ", ".join(f"COALESCE({qi(a)}, m{i}) AS {qi(a)}" for i, a in enumerate(A))
    return f"""{model_ctes()},
clf AS (SELECT {KEYS_SQL}, {", ".join(qi(a) for a in A)}, post_fire FROM model WHERE {present} >= 3),
med AS (SELECT {meds} FROM clf),
imp AS (SELECT {KEYS_SQL}, {imp}, post_fire FROM clf CROSS JOIN med)"""


def _hash(seed=42):
    return (f"('0x' || substr(md5(StationCode || '|' || CAST(SampleDate AS VARCHAR) || '|' || "
            f"CAST(index_right AS VARCHAR) || ':{seed}'), 1, 13))::BIGINT")


def _albers_sql() -> str:
    from cinderwell.functions.geometry import AlbersParams
    p = AlbersParams()
    c1, c2, c3 = p.series()
    x = "CAST(((s_suppkey * 7919) % 1000) * 1000 - 500000 AS DOUBLE)"
    y = "CAST(((s_suppkey * 104729) % 1000) * 1000 - 300000 AS DOUBLE)"
    xs = f"({x} - {p.fe!r})"
    ys = f"({p.rho0!r} - ({y} - {p.fn!r}))"
    rho = f"sqrt({xs} * {xs} + {ys} * {ys})"
    qq = f"(({p.C!r} - {rho} * {rho} * {p.n * p.n / (p.a * p.a)!r}) / {p.n!r})"
    beta = f"asin(GREATEST(-1.0, LEAST(1.0, {qq} / {p.qp!r})))"
    phi = f"({beta} + {c1!r} * sin(2 * {beta}) + {c2!r} * sin(4 * {beta}) + {c3!r} * sin(6 * {beta}))"
    lam = f"({p.lon0!r} + atan2({xs}, {ys}) / {p.n!r})"
    return (f"SELECT s_suppkey AS station_key, {rnd(x)} AS x, {rnd(y)} AS y, "
            f"{rnd(f'degrees({lam})')} AS lon, {rnd(f'degrees({phi})')} AS lat FROM supplier")


def _class_report(pred_ctes: str) -> str:
    return f"""{pred_ctes},
grid AS (SELECT a.c AS actual, p.c AS predicted FROM (VALUES (0), (1)) a(c) CROSS JOIN (VALUES (0), (1)) p(c)),
cnt AS (SELECT post_fire AS actual, prediction AS predicted, count(*) AS n FROM pred GROUP BY ALL),
cm AS (SELECT g.actual, g.predicted, CAST(COALESCE(c.n, 0) AS BIGINT) AS n FROM grid g
       LEFT JOIN cnt c ON g.actual = c.actual AND g.predicted = c.predicted),
rep AS (
  SELECT t.cls, COALESCE(CAST(t.tp AS DOUBLE) / NULLIF(pp.pred_pos, 0), 0.0) AS precision,
         COALESCE(CAST(t.tp AS DOUBLE) / NULLIF(s.support, 0), 0.0) AS recall, s.support
  FROM (SELECT actual AS cls, n AS tp FROM cm WHERE actual = predicted) t
  JOIN (SELECT actual AS cls, CAST(sum(n) AS BIGINT) AS support FROM cm GROUP BY actual) s ON t.cls = s.cls
  JOIN (SELECT predicted AS cls, CAST(sum(n) AS BIGINT) AS pred_pos FROM cm GROUP BY predicted) pp ON t.cls = pp.cls),
rep2 AS (SELECT *, COALESCE(2 * precision * recall / NULLIF(precision + recall, 0), 0.0) AS f1 FROM rep)"""


RULE_PRED = f"""{model_ctes()},
pred AS (SELECT post_fire, CAST(month >= 7 AS INTEGER) AS prediction FROM model)"""

FEATS = ["days_since_fire", "log_acres", "season_num", "TargetLatitude", "TargetLongitude", "Region"]

SQL.update({
    "model_frame": with_(model_ctes(), f"""SELECT {KEYS_SQL}, FIRE_NAME, days_since_fire, post_fire, {_r('log_acres')},
  month, season_num, {_r('TargetLatitude')}, {_r('TargetLongitude')}, Region, {", ".join(_r(a) for a in A)} FROM model"""),
    "row_counts": with_(model_ctes(), """SELECT 'master_rows' AS name, CAST(count(*) AS BIGINT) AS n FROM master
UNION ALL SELECT 'joined_rows', CAST(count(*) AS BIGINT) FROM joined
UNION ALL SELECT 'matched_rows', CAST(count(*) AS BIGINT) FROM joined WHERE FIRE_NAME IS NOT NULL
UNION ALL SELECT 'same_year_rows', CAST(count(*) AS BIGINT) FROM joined WHERE FIRE_NAME IS NOT NULL AND SampleYear = FireYear
UNION ALL SELECT 'one_month_rows', CAST(count(*) AS BIGINT) FROM joined WHERE FIRE_NAME IS NOT NULL AND days_since_fire BETWEEN 0 AND 30
UNION ALL SELECT 'window_rows', CAST(count(*) AS BIGINT) FROM model
UNION ALL SELECT 'pre_fire_rows', CAST(count(*) AS BIGINT) FROM model WHERE post_fire = 0
UNION ALL SELECT 'post_fire_rows', CAST(count(*) AS BIGINT) FROM model WHERE post_fire = 1"""),
    "class_balance": with_(clf_ctes(), """SELECT post_fire, round_even(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 2) AS share,
  CAST(count(*) AS BIGINT) AS n FROM clf GROUP BY post_fire"""),
    "reproject_points": _albers_sql(),
    "complete_cases": with_(model_ctes(), "\nUNION ALL ".join(
        f"SELECT '{a}' AS Analyte, CAST(count(*) AS BIGINT) AS n FROM model WHERE "
        + " AND ".join(f"{qi(c)} IS NOT NULL" for c in FEATS + [a]) for a in A)),
    "min_non_null": with_(clf_ctes(), f"SELECT {KEYS_SQL}, {', '.join(_r(a) for a in A)}, post_fire FROM clf"),
    "median_impute": with_(clf_ctes(), f"SELECT {KEYS_SQL}, {', '.join(_r(a) for a in A)}, post_fire FROM imp"),
    "standardize": with_(clf_ctes() + ",\nst AS (SELECT " + ", ".join(
        f"avg({qi(a)}) AS mu{i}, stddev_pop({qi(a)}) AS sd{i}" for i, a in enumerate(A)) + " FROM imp)",
        f"SELECT {KEYS_SQL}, " + ", ".join(
            f"{rnd(f'({qi(a)} - mu{i}) / (CASE WHEN sd{i} IS NULL OR sd{i} = 0 THEN 1.0 ELSE sd{i} END)')} AS {qi(a)}"
            for i, a in enumerate(A)) + ", post_fire FROM imp CROSS JOIN st"),
    "balanced_weights": with_(clf_ctes(), """SELECT post_fire, round(CAST(sum(count(*)) OVER () AS DOUBLE) /
  (count(*) OVER () * count(*)), 6) AS weight, CAST(count(*) AS BIGINT) AS n FROM clf GROUP BY post_fire"""),
    "class_change": with_(clf_ctes() + ",\ncm AS (" + "\n  UNION ALL ".join(
        f"SELECT '{a}' AS Analyte, avg(CASE WHEN post_fire = 0 THEN {qi(a)} END) AS b, "
        f"avg(CASE WHEN post_fire = 1 THEN {qi(a)} END) AS a FROM imp" for a in A) + ")",
        """SELECT Analyte, round_even(b, 3) AS "before", round_even(a, 3) AS "after",
  round_even((a - b) / NULLIF(b, 0) * 100, 1) AS pct_change,
  CASE WHEN (a - b) / NULLIF(b, 0) * 100 > 0 THEN '↑' ELSE '↓' END AS direction FROM cm"""),
    "hash_split": with_(model_ctes(), f"""SELECT {KEYS_SQL},
  row_number() OVER (ORDER BY {_hash()}) <= ceil(0.2 * count(*) OVER ()) AS is_test FROM model"""),
    "stratified_split": with_(clf_ctes(), f"""SELECT {KEYS_SQL}, post_fire,
  row_number() OVER (PARTITION BY post_fire ORDER BY {_hash()}) <= ceil(0.2 * count(*) OVER (PARTITION BY post_fire))
  AS is_test FROM clf"""),
    "capped_sample": with_(model_ctes(), f"SELECT {KEYS_SQL}, days_since_fire FROM model ORDER BY {_hash()} LIMIT 5000"),
    "confusion_report": with_(_class_report(RULE_PRED), f"""SELECT CAST(cls AS VARCHAR) AS cls, {_r('precision')}, {_r('recall')},
  {_r('f1')}, support FROM rep2
UNION ALL SELECT 'accuracy', NULL, NULL, {rnd('(SELECT CAST(sum(n) AS DOUBLE) FROM cm WHERE actual = predicted) / (SELECT sum(n) FROM cm)')}, (SELECT CAST(sum(n) AS BIGINT) FROM cm)
UNION ALL SELECT 'macro avg', {rnd('avg(precision)')}, {rnd('avg(recall)')}, {rnd('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM rep2
UNION ALL SELECT 'weighted avg', {rnd('sum(precision * support) / sum(support)')}, {rnd('sum(recall * support) / sum(support)')},
  {rnd('sum(f1 * support) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM rep2"""),
    "weighted_metrics": with_(_class_report(RULE_PRED), f"""SELECT
  {rnd('(SELECT CAST(sum(n) AS DOUBLE) FROM cm WHERE actual = predicted) / (SELECT sum(n) FROM cm)')} AS accuracy,
  {rnd('sum(precision * support) / sum(support)')} AS precision,
  {rnd('sum(recall * support) / sum(support)')} AS recall,
  {rnd('sum(f1 * support) / sum(support)')} AS f1,
  CAST(sum(support) AS BIGINT) AS n FROM rep2"""),
    "r2": with_(model_ctes() + f""",
m AS (SELECT season_num, {qi(A[0])} AS y FROM model WHERE season_num IS NOT NULL AND {qi(A[0])} IS NOT NULL),
g AS (SELECT season_num, avg(y) AS p FROM m GROUP BY season_num)""",
        f"""SELECT {rnd('CASE WHEN sum(y * y) - sum(y) * sum(y) / count(y) > 0 THEN 1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(y)) END')} AS r2,
  CAST(count(y) AS BIGINT) AS n FROM m JOIN g USING (season_num)"""),
})

_FLAG_WORDS = {"A": "Accepted", "N": "None", "R": "Returned", "F": "Filled", "O": "Open"}
SQL["display_names"] = with_(readings_cte(), "SELECT DISTINCT Analyte, CASE Analyte "
                             + " ".join(f"WHEN '{a}' THEN '{_FLAG_WORDS[a[0]]} {_FLAG_WORDS[a[-1]]}'" for a in A)
                             + " END AS display_name FROM readings WHERE Analyte IS NOT NULL")

SQL["mixed_station_stats"] = with_(model_ctes() + ",\nlong AS (" + "\n  UNION ALL ".join(
    f"SELECT '{a}' AS Analyte, StationCode, CAST(post_fire AS DOUBLE) AS x, {qi(a)} AS y FROM model" for a in A) + ")",
    f"""SELECT Analyte, StationCode, CAST(count(*) AS BIGINT) AS n, {rnd('sum(x)')} AS sx, {rnd('sum(y)')} AS sy,
  {rnd('sum(x * x)')} AS sxx, {rnd('sum(x * y)')} AS sxy, {rnd('sum(y * y)')} AS syy
FROM long WHERE y IS NOT NULL AND x IS NOT NULL AND StationCode IS NOT NULL GROUP BY Analyte, StationCode""")

SQL["station_fire_join_edges"] = SQL["station_fire_join_cells"] = SQL["station_fire_join"]

SQL["edge_sides"] = """WITH k AS (SELECT o_orderkey, 1 + o_orderkey * 7 % 97 AS u, 1 + o_custkey * 13 % 89 AS v, 1000 + o_orderkey % 500 AS m,
    o_custkey * 31 % (1000 + o_orderkey % 500) AS j, o_orderkey % 3 - 1 AS beside FROM orders)
SELECT o_orderkey, CAST(sign(m * u * (j * v) - m * v * (j * u + beside)) AS INTEGER) AS side FROM k"""


def _ranges_sql() -> str:
    parts = []
    for a in A:
        ok = " AND ".join(f"{qi(c)} IS NOT NULL" for c in FEATS + [a, "post_fire"])
        for f in FEATS:
            parts.append(f"""SELECT '{a}' AS target, '{f}' AS feature, CAST(count(*) AS BIGINT) AS n,
  {rnd(f'min(CAST({qi(f)} AS DOUBLE))')} AS lo, {rnd(f'max(CAST({qi(f)} AS DOUBLE))')} AS hi
FROM model WHERE {ok}""")
    return with_(model_ctes(), "\nUNION ALL ".join(parts))


SQL["gam_basis_ranges"] = _ranges_sql()


#: the four cubic weights at place t of an interval
_CUBIC = ["(1 - t) * (1 - t) * (1 - t) / 6.0", "(3 * t * t * t - 6 * t * t + 4) / 6.0", "(-3 * t * t * t + 3 * t * t + 3 * t + 1) / 6.0", "t * t * t / 6.0"]


def gram_ctes() -> str:
    """Cubic B-spline design of every complete row as (row, index, weight)
    entries, joined to itself and summed."""
    from cinderwell.sources.schema import MODEL_FEATURES
    feats = list(MODEL_FEATURES)
    complete = " UNION ALL ".join(
        f"SELECT '{t}' AS target, rn, {qi(t)} AS y, post_fire AS label, " + ", ".join(f"CAST({qi(f)} AS DOUBLE) AS f{i}" for i, f in enumerate(feats))
        + f" FROM numbered WHERE {qi(t)} IS NOT NULL AND post_fire IS NOT NULL AND " + " AND ".join(f"{qi(f)} IS NOT NULL" for f in feats)
        for t in A)
    facts = ", ".join(f"min(f{i}) AS lo{i}, max(f{i}) AS hi{i}" for i in range(len(feats)))
    places = " UNION ALL ".join(
        f"SELECT c.target, rn, {1 + 20 * i} AS base, greatest(0.0, least(1.0, (f{i} - lo{i}) / CASE WHEN hi{i} > lo{i} THEN hi{i} - lo{i} ELSE 1.0 END)) * 17.0 AS u "
        f"FROM complete c JOIN facts USING (target)" for i in range(len(feats)))
    last = 1 + 20 * len(feats)
    entries = " UNION ALL ".join(f"SELECT target, rn, base + j + {k} AS i, {w} AS v FROM placed" for k, w in enumerate(_CUBIC))
    return model_ctes() + f""",
numbered AS (SELECT row_number() OVER () AS rn, * FROM model),
complete AS ({complete}),
facts AS (SELECT target, count(*) AS n, avg(y) AS mean, {facts} FROM complete GROUP BY target),
located AS ({places}),
placed AS (SELECT target, rn, base, CAST(least(floor(u), 16) AS INTEGER) AS j, u - least(floor(u), 16) AS t FROM located),
entries AS ({entries}
  UNION ALL SELECT target, rn, 0, 1.0 FROM complete
  UNION ALL SELECT target, rn, {last}, y - mean FROM complete JOIN facts USING (target)),
cells AS (SELECT a.target, a.i, b.i AS j, sum(a.v * b.v) AS value
  FROM entries a JOIN entries b ON a.target = b.target AND a.rn = b.rn AND a.i <= b.i GROUP BY ALL)"""



SQL["gam_gram"] = with_(gram_ctes(), """SELECT target, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(value, 4) AS value
FROM cells WHERE round(value, 4) <> 0""")


def gam_ctes(lam: float = 0.6, ridge: float = 1e-6, min_rows: int = 100) -> str:
    """The penalised system of each target with enough rows, a list for each
    row of the matrix, eliminated by a recursive query, one pivot a step."""
    p = 1 + 20 * len(FEATS)
    d2 = "CASE abs(a - b) WHEN 0 THEN CASE WHEN a IN (0, 19) THEN 1.0 WHEN a IN (1, 18) THEN 5.0 ELSE 6.0 END " \
         "WHEN 1 THEN CASE WHEN least(a, b) IN (0, 18) THEN -2.0 ELSE -4.0 END WHEN 2 THEN 1.0 ELSE 0.0 END"
    return f"""{gram_ctes()},
idx AS (SELECT CAST(range AS INTEGER) AS i FROM range({p + 1})),
dense AS (
  SELECT f.target, a.i, b.i AS j, coalesce(c.value, 0.0)::DOUBLE AS v
  FROM (SELECT target FROM facts WHERE n >= {min_rows}) f CROSS JOIN idx a CROSS JOIN idx b
  LEFT JOIN cells c ON c.target = f.target AND c.i = least(a.i, b.i) AND c.j = greatest(a.i, b.i)),
gram AS (SELECT target, i, list(v ORDER BY j) AS r FROM dense GROUP BY target, i),
pen AS (SELECT a.i, b.i AS j, {lam}::DOUBLE * {d2} AS v
  FROM (SELECT i, (i - 1) % 20 AS a FROM idx WHERE i BETWEEN 1 AND {p - 1}) a
  JOIN (SELECT i, (i - 1) % 20 AS b FROM idx WHERE i BETWEEN 1 AND {p - 1}) b ON (a.i - 1) // 20 = (b.i - 1) // 20),
start AS (
  SELECT d.target, d.i, list(d.v + coalesce(pen.v + z.r[d.i + 1] * z.r[d.j + 1] / z.r[1], 0.0)
                             + CASE WHEN d.i = d.j AND d.i < {p} THEN {ridge}::DOUBLE ELSE 0.0 END ORDER BY d.j) AS r
  FROM dense d JOIN gram z ON z.target = d.target AND z.i = 0 LEFT JOIN pen ON pen.i = d.i AND pen.j = d.j GROUP BY d.target, d.i),
steps AS (
  WITH RECURSIVE e AS (
    SELECT 0 AS k, target, i, r FROM start
    UNION ALL
    SELECT k + 1, target, i,
           CASE WHEN i = k THEN list_transform(z, lambda v, j: CASE WHEN j = k + 1 THEN 1 / v ELSE v / z[k + 1] END)
                ELSE list_transform(r, lambda v, j: CASE WHEN j = k + 1 THEN -v / z[k + 1] ELSE v - r[k + 1] * z[j] / z[k + 1] END) END
    FROM (SELECT *, max(CASE WHEN i = k THEN r END) OVER (PARTITION BY target) AS z FROM e) WHERE k < {p})
  SELECT target, i, r FROM e WHERE k = {p}),
sol AS (SELECT target, list(r[{p + 1}] ORDER BY i) AS beta FROM steps WHERE i < {p} GROUP BY target),
sums AS (
  SELECT g.target, sum(list_dot_product(e.r[1:{p}], g.r[1:{p}])) AS edof,
         sum(s.beta[g.i + 1] * (list_dot_product(g.r[1:{p}], s.beta) - 2 * g.r[{p + 1}])) AS part
  FROM gram g JOIN steps e USING (target, i) JOIN sol s USING (target) WHERE g.i < {p} GROUP BY g.target),
fit AS (
  SELECT target, f.n, f.mean, s.beta, edof, greatest(y.r[{p + 1}] + part, 0) AS rss,
         greatest(y.r[{p + 1}] - y.r[1] * y.r[1] / f.n, 0) AS rss0, rss / greatest(f.n - edof, 1) AS scale, f.lo0, f.hi0
  FROM facts f JOIN sol s USING (target) JOIN sums USING (target) JOIN gram y USING (target) WHERE y.i = {p}),
half AS (
  SELECT e.target, e.i, list(list_dot_product(e.r[1:{p}], g.r[1:{p}]) ORDER BY g.i) AS h
  FROM steps e JOIN gram g USING (target) WHERE e.i BETWEEN 1 AND 20 AND g.i < {p} GROUP BY e.target, e.i),
cov AS (SELECT h.target, h.i AS a, e.i AS b, list_dot_product(h.h, e.r[1:{p}]) AS v FROM half h JOIN steps e USING (target) WHERE e.i BETWEEN 1 AND 20),
grid AS (
  SELECT target, CAST(range AS INTEGER) AS i, lo0 + (hi0 - lo0) * range / 199 AS x,
         greatest(0.0, least(1.0, (lo0 + (hi0 - lo0) * range / 199 - lo0) / CASE WHEN hi0 > lo0 THEN hi0 - lo0 ELSE 1.0 END)) * 17.0 AS u, beta, scale
  FROM fit CROSS JOIN range(200)),
gridp AS (SELECT *, CAST(least(floor(u), 16) AS INTEGER) AS j, u - least(floor(u), 16) AS t FROM grid),
gridw AS (SELECT target, i, x, beta, scale, unnest([j + 1, j + 2, j + 3, j + 4]) AS a,
          unnest([{", ".join(_CUBIC)}]) AS w FROM gridp),
curve AS (
  SELECT g.target, g.i, g.x, sum(g.w * g.beta[g.a + 1]) AS effect, any_value(g.scale) AS scale FROM gridw g GROUP BY g.target, g.i, g.x),
spread AS (SELECT a.target, a.i, sum(a.w * b.w * c.v) AS v FROM gridw a JOIN gridw b USING (target, i) JOIN cov c ON c.target = a.target AND c.a = a.a AND c.b = b.a GROUP BY a.target, a.i),
predicted AS (
  SELECT e.target, e.rn, round(any_value(f.mean) + sum(e.v * f.beta[e.i + 1]), 9) AS prediction
  FROM entries e JOIN fit f USING (target) WHERE e.i < {p} GROUP BY e.target, e.rn),
judged AS (
  SELECT c.target, c.label, CAST(p.prediction >= m.cut AS INTEGER) AS cls
  FROM predicted p JOIN complete c USING (target, rn) JOIN (SELECT target, median(prediction) AS cut FROM predicted GROUP BY target) m USING (target)),
classes AS (
  SELECT target, c AS cls, count(*) AS n, count_if(label = c AND cls = c) AS tp, count_if(label = c) AS support, count_if(cls = c) AS named
  FROM judged CROSS JOIN (VALUES (0), (1)) v(c) GROUP BY target, c),
rates AS (SELECT *, coalesce(tp / nullif(named, 0), 0) AS pr, coalesce(tp / nullif(support, 0), 0) AS re FROM classes),
metrics AS (
  SELECT target, sum(tp) / any_value(n) AS acc, sum(pr * support) / any_value(n) AS pr, sum(re * support) / any_value(n) AS re,
         sum(coalesce(2 * pr * re / nullif(pr + re, 0), 0) * support) / any_value(n) AS f1 FROM rates GROUP BY target),
change AS (SELECT target, avg(effect) FILTER (x > 0) - avg(effect) FILTER (x < 0) AS change FROM curve GROUP BY target),
every(target) AS (VALUES {", ".join(f"('{a}')" for a in A)})"""


_LL = "f.n * ln(2 * pi() * f.scale)"
SQL["gam_coefficients"] = with_(gam_ctes(), """SELECT target, CAST(i AS INTEGER) AS i, round(beta[i + 1] + CASE WHEN i = 0 THEN mean ELSE 0 END, 5) AS beta
FROM fit JOIN idx ON i < len(beta)""")
SQL["gam_curve"] = with_(gam_ctes(), """SELECT c.target AS Analyte, c.i, round(c.x, 5) AS x, round(effect, 5) AS effect,
  round(effect - 1.959963984540054 * sqrt(greatest(scale * s.v, 0)), 5) AS lower, round(effect + 1.959963984540054 * sqrt(greatest(scale * s.v, 0)), 5) AS upper
FROM curve c JOIN spread s ON s.target = c.target AND s.i = c.i""")
SQL["gam_results"] = with_(gam_ctes(), f"""SELECT e.target AS Analyte,
  round_even(CASE WHEN f.scale > 0 THEN ({_LL} + f.rss / f.scale) / nullif({_LL} + f.rss0 / f.scale, 0) END, 4) AS r2,
  round_even(CASE WHEN f.rss0 > 0 THEN 1 - f.rss / f.rss0 END, 4) AS explained_deviance,
  round_even(c.change, 4) AS post_fire_change,
  CASE WHEN f.target IS NULL THEN NULL WHEN c.change > 0 THEN '↑ increases' ELSE '↓ decreases' END AS Direction,
  round_even(m.acc, 4) AS Accuracy, round_even(m.pr, 4) AS "Precision", round_even(m.re, 4) AS Recall, round_even(m.f1, 4) AS F1,
  CAST(coalesce(k.n, 0) AS BIGINT) AS n, CASE WHEN f.target IS NULL THEN 'fewer than 100 complete rows' ELSE 'ok' END AS status
FROM every e LEFT JOIN facts k USING (target) LEFT JOIN fit f USING (target) LEFT JOIN change c USING (target) LEFT JOIN metrics m USING (target)""")


SQL["mixed_grid_sums"] = with_(model_ctes() + ",\nlong AS (" + "\n  UNION ALL ".join(
    f"SELECT '{a}' AS Analyte, StationCode, CAST(post_fire AS DOUBLE) AS x, {qi(a)} AS y FROM model" for a in A) + """),
st AS (SELECT Analyte, StationCode, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy
  FROM long WHERE y IS NOT NULL AND x IS NOT NULL AND StationCode IS NOT NULL GROUP BY Analyte, StationCode),
ratio(gamma) AS (VALUES (0.0::DOUBLE), (0.01::DOUBLE), (0.1::DOUBLE), (1.0::DOUBLE), (10.0::DOUBLE)),
w AS (SELECT *, gamma / (1 + n * gamma) AS w FROM st, ratio)""",
    f"""SELECT Analyte, gamma, {rnd('sum(n - w * n * n)', 4)} AS a00, {rnd('sum(sx - w * n * sx)', 4)} AS a01, {rnd('sum(sxx - w * sx * sx)', 4)} AS a11,
  {rnd('sum(sy - w * n * sy)', 4)} AS b0, {rnd('sum(sxy - w * sx * sy)', 4)} AS b1, {rnd('sum(syy - w * sy * sy)', 4)} AS c,
  {rnd('sum(ln(1 + n * gamma))', 4)} AS logdet, {rnd('sum(n)', 4)} AS N, count(*) AS groups FROM w GROUP BY Analyte, gamma""")


# --------------------------------------------------------------------------
# Trees: one level of CTEs a depth
# --------------------------------------------------------------------------
TREE_DEPTH, TREE_LEAF, TREE_BINS = 4, 20, 64
TREE_BINNED = ["days_since_fire", "log_acres", "TargetLatitude", "TargetLongitude"]


def _levels(p: str, start: str) -> str:
    """Trees over ``start`` (target, y, w, xs), CTE names with prefix ``p``:
    rows, histograms, cuts and best splits of each depth, and all nodes."""
    out = [f"{p}l0 AS (SELECT CAST(1 AS BIGINT) AS node, * FROM {start})"]
    for d in range(TREE_DEPTH + 1):
        leaf = TREE_LEAF if d < TREE_DEPTH else 1 << 62
        out.append(f"""{p}h{d} AS (
  SELECT target, node, f, x, count(*) AS n, sum(w) AS w, sum(w * y) AS s
  FROM (SELECT target, node, y, w, unnest(range(len(xs))) AS f, unnest(xs) AS x FROM {p}l{d}) GROUP BY ALL)""")
        out.append(f"""{p}c{d} AS (
  SELECT target, node, f, x, sum(n) OVER c AS ln, sum(w) OVER c AS lw, sum(s) OVER c AS ls, sum(n) OVER a AS an, sum(w) OVER a AS aw, sum(s) OVER a AS "as"
  FROM {p}h{d} WINDOW c AS (PARTITION BY target, node, f ORDER BY x), a AS (PARTITION BY target, node, f))""")
        out.append(f"""{p}g{d} AS (
  SELECT target, node, f, x, CASE WHEN ln >= {leaf} AND an - ln >= {leaf}
    THEN round(ls * ls / nullif(lw, 0) + ("as" - ls) * ("as" - ls) / nullif(aw - lw, 0) - "as" * "as" / nullif(aw, 0), 6) END AS gain FROM {p}c{d})""")
        out.append(f"""{p}b{d} AS (
  SELECT t.target, t.node, CAST({d} AS INTEGER) AS depth, CAST(t.n AS BIGINT) AS n, t.weight, t.value,
         CASE WHEN b.gain > 0 THEN b.gain END AS gain, CASE WHEN b.gain > 0 THEN CAST(b.f AS INTEGER) END AS feature, CASE WHEN b.gain > 0 THEN b.x END AS cut
  FROM (SELECT target, node, any_value(an) AS n, any_value(aw) AS weight, any_value("as" / aw) AS value FROM {p}c{d} WHERE f = 0 GROUP BY target, node) t
  JOIN (SELECT *, row_number() OVER (PARTITION BY target, node ORDER BY gain DESC NULLS LAST, f, x) AS place FROM {p}g{d}) b
    ON b.target = t.target AND b.node = t.node AND b.place = 1)""")
        if d < TREE_DEPTH:
            out.append(f"""{p}l{d + 1} AS (
  SELECT 2 * l.node + CAST(l.xs[b.feature + 1] > b.cut AS BIGINT) AS node, l.* EXCLUDE (node)
  FROM {p}l{d} l JOIN {p}b{d} b ON b.target = l.target AND b.node = l.node WHERE b.feature IS NOT NULL)""")
    out.append(f"{p}tree AS (" + " UNION ALL ".join(f"SELECT * FROM {p}b{d}" for d in range(TREE_DEPTH + 1)) + ")")
    return ",\n".join(out)


def _walk(p: str, start: str) -> str:
    """``start`` at its leaves: (.., node, prediction) as CTE {p}voted."""
    out = [f"{p}w0 AS (SELECT CAST(1 AS BIGINT) AS node, * FROM {start})"]
    for d in range(TREE_DEPTH):
        out.append(f"""{p}w{d + 1} AS (
  SELECT CASE WHEN b.feature IS NULL THEN w.node ELSE 2 * w.node + CAST(w.xs[b.feature + 1] > b.cut AS BIGINT) END AS node, w.* EXCLUDE (node)
  FROM {p}w{d} w LEFT JOIN {p}b{d} b ON b.target = w.target AND b.node = w.node)""")
    out.append(f"{p}voted AS (SELECT w.*, t.value AS prediction FROM {p}w{TREE_DEPTH} w JOIN {p}tree t ON t.target = w.target AND t.node = w.node)")
    return ",\n".join(out)


def _importances(p: str, names) -> str:
    listed = ", ".join(f"({i}, '{f}')" for i, f in enumerate(names))
    return f"""{p}imp AS (
  SELECT t.target, v.f AS place, v.name AS feature, coalesce(sum(t.gain) FILTER (t.feature = v.f), 0) / coalesce(nullif(sum(t.gain), 0), 1) AS importance
  FROM {p}tree t CROSS JOIN (VALUES {listed}) v(f, name) GROUP BY ALL)"""


def regression_tree_ctes() -> str:
    cuts = []
    for f in TREE_BINNED:
        ranks = ", ".join(f"len(v) * {k} // {TREE_BINS}" for k in range(1, TREE_BINS))
        cuts.append(f"(SELECT list_sort(list_distinct(list_transform([{ranks}], lambda k: v[k + 1]))) FROM "
                    f"(SELECT list(CAST({qi(f)} AS DOUBLE) ORDER BY {qi(f)}) FILTER ({qi(f)} IS NOT NULL) AS v FROM model)) AS k_{f}")
    bin_ = lambda f: (f"coalesce(list_filter(k_{f}, lambda c: c >= m.{qi(f)})[1], 'infinity'::DOUBLE)" if f in TREE_BINNED
                      else f"CAST(m.{qi(f)} AS DOUBLE)")
    complete = " AND ".join(f"m.{qi(f)} IS NOT NULL" for f in FEATS)
    ys = " UNION ALL ".join(f"SELECT '{a}' AS target, CAST({qi(a)} AS DOUBLE) AS y, CAST(1 AS DOUBLE) AS w, xs, is_test FROM seen WHERE {qi(a)} IS NOT NULL" for a in A)
    return f"""{model_ctes()},
cuts AS (SELECT {", ".join(cuts)}),
parted AS (SELECT *, row_number() OVER (ORDER BY {_hash()}) <= ceil(0.2 * count(*) OVER ()) AS is_test FROM model),
seen AS (SELECT {", ".join("m." + qi(a) for a in A)}, m.is_test, [{", ".join(bin_(f) for f in FEATS)}] AS xs FROM parted m CROSS JOIN cuts WHERE {complete}),
every_row AS ({ys}),
train AS (SELECT target, y, w, xs FROM every_row WHERE NOT is_test),
test AS (SELECT target, y, w, xs FROM every_row WHERE is_test),
{_levels("r", "train")},
{_walk("r", "test")},
{_importances("r", FEATS)}"""


def classifier_tree_ctes() -> str:
    xs = ", ".join(f"CAST({qi(a)} AS DOUBLE)" for a in A)
    return f"""{clf_ctes()},
parted AS (SELECT *, row_number() OVER (PARTITION BY post_fire ORDER BY {_hash()}) <= ceil(0.2 * count(*) OVER (PARTITION BY post_fire)) AS is_test FROM imp),
weights AS (SELECT post_fire, sum(count(*)) OVER ()::DOUBLE / (count(*) OVER () * count(*)) AS w FROM parted WHERE NOT is_test GROUP BY post_fire),
train AS (SELECT 'post_fire' AS target, CAST(post_fire AS DOUBLE) AS y, w, [{xs}] AS xs FROM parted JOIN weights USING (post_fire) WHERE NOT is_test),
test AS (SELECT 'post_fire' AS target, CAST(post_fire AS DOUBLE) AS y, CAST(1 AS DOUBLE) AS w, [{xs}] AS xs FROM parted WHERE is_test),
{_levels("k", "train")},
{_walk("k", "test")},
{_importances("k", A)}"""


SQL["rf_tree_splits"] = with_(regression_tree_ctes(), """SELECT target, node, depth, n, round(value, 4) AS value, round(gain, 4) AS gain, feature, round(cut, 4) AS cut FROM rtree""")
SQL["rf_tree_importances"] = with_(regression_tree_ctes(), f"SELECT target AS Analyte, feature, {rnd('importance')} AS importance FROM rimp")
SQL["rf_tree_results"] = with_(regression_tree_ctes(), """SELECT e.target AS Analyte,
  round(CASE WHEN e.v > 0 THEN 1 - e.sse / (e.n * e.v) END, 4) AS r2, t.top_feature, CAST(e.n AS BIGINT) AS n_test
FROM (SELECT target, count(*) AS n, sum((y - prediction) * (y - prediction)) AS sse, var_pop(y) AS v FROM rvoted GROUP BY target) e
JOIN (SELECT target, feature AS top_feature FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(importance, 9) DESC, place) AS rk FROM rimp) WHERE rk = 1) t USING (target)""")
SQL["clf_tree_splits"] = with_(classifier_tree_ctes(), """SELECT target, node, depth, n, round(weight, 4) AS weight, round(value, 4) AS value, round(gain, 4) AS gain, feature,
  round(cut, 4) AS cut FROM ktree""")
SQL["clf_tree_confusion"] = with_(classifier_tree_ctes(), """SELECT a.c AS actual, p.c AS predicted, CAST(count(v.y) AS BIGINT) AS n
FROM (VALUES (0), (1)) a(c) CROSS JOIN (VALUES (0), (1)) p(c)
LEFT JOIN kvoted v ON v.y = a.c AND CAST(v.prediction > 0.5 AS INTEGER) = p.c GROUP BY a.c, p.c""")
SQL["clf_tree_ranking"] = with_(classifier_tree_ctes() + ",\nmeans AS (" + "\n  UNION ALL ".join(
    f"SELECT '{a}' AS Analyte, avg(CASE WHEN post_fire = 0 THEN {qi(a)} END) AS b, avg(CASE WHEN post_fire = 1 THEN {qi(a)} END) AS a FROM imp" for a in A) + ")",
    "SELECT CASE m.Analyte " + " ".join(f"WHEN '{a}' THEN '{_FLAG_WORDS[a[0]]} {_FLAG_WORDS[a[-1]]}'" for a in A) + """ END AS Analyte,
  round_even(b, 3) AS "Before", round_even(a, 3) AS "After", round_even((a - b) / nullif(b, 0) * 100, 1) AS pct_change,
  CASE WHEN (a - b) / nullif(b, 0) * 100 > 0 THEN '↑' ELSE '↓' END AS Direction, round_even(i.importance, 4) AS Importance
FROM means m JOIN kimp i ON i.feature = m.Analyte""")

SQL["readings_csv"] = with_(readings_cte(), f"""SELECT StationCode, SampleDate, StationName, {_r('TargetLatitude')}, {_r('TargetLongitude')}, Region,
  Analyte, {_r('Result')}, CASE WHEN Analyte NOT LIKE 'R%' THEN Unit END AS Unit FROM readings""")
SQL["fires_csv"] = with_(fires_cte(), f"SELECT fire_id, FIRE_NAME, ALARM_DATE, {_r('GIS_ACRES')} FROM fires")


def _placed(name: str, order: str) -> str:
    return f"SELECT *, CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS position FROM ({SQL[name]}) t"


SQL["ranking_sorted"] = _placed("clf_tree_ranking", "Importance DESC, Analyte")
SQL["rf_tree_results_sorted"] = _placed("rf_tree_results", "r2 DESC NULLS LAST, Analyte")
SQL["same_year_sorted"] = _placed("same_year_matches", ", ".join(
    f"{c} NULLS FIRST" for c in ("StationCode", "SampleDate", "StationName", "TargetLatitude", "TargetLongitude", "Region", "index_right")))
