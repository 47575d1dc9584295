"""The same queries as SQL for DuckDB, written independently over the given order tables."""

from __future__ import annotations

from checks.race_tables import CUTOFF, PLACES, SEARCHED, WINDOW
from oddsmith.recipes import FINAL_FEATURES
from oddsmith.settings import K_GRID


def six(expression: str, name: str | None = None) -> str:
    """A double to six places (odds to four), through a decimal."""
    name = name or expression
    places = PLACES.get(name, 6)
    return f"cast(round(cast({expression} AS decimal(24,9)), {places}) AS double) AS {name}"


SECONDS = """CASE WHEN running_time IS NULL OR running_time = '' THEN NULL
 WHEN instr(running_time, ':') = 0 THEN try_cast(running_time AS double)
 WHEN length(running_time) - length(replace(running_time, ':', '')) = 1
 THEN try_cast(split_part(running_time, ':', 1) AS double) * 60
    + try_cast(split_part(running_time, ':', 2) AS double) END"""
SPEED = f"(cast(distance AS double) / nullif({SECONDS}, 0))"


def _grade(top: str, second: str) -> str:
    title = "concat(race_name, ' ', race_class)"
    return f"""CASE WHEN {top.format(t=title)} THEN 4 WHEN {second.format(t=title)} THEN 3
 WHEN contains({title}, 'G3') OR contains({title}, 'GIII') THEN 2
 WHEN contains({title}, 'オープン') OR contains({title}, 'リステッド')
   OR contains({title}, '(L)') THEN 1 ELSE 0 END"""


GRADE = _grade(
    "(contains({t}, 'G1') OR contains({t}, 'GI ') OR contains({t}, ' GI'))",
    "(contains({t}, 'G2') OR contains({t}, 'GII'))",
)
STRICT_GRADE = _grade(
    "(race_class IN ('G1', 'GI'))", "(race_class IN ('G2', 'GII'))"
)

BASE = """WITH lines AS (
  SELECT *, (l_returnflag = 'R' AND l_linestatus = 'F') AS scratched,
    cast(round(l_extendedprice * 100) AS bigint) AS pool,
    cast(row_number() OVER (PARTITION BY l_orderkey
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS int) AS horse_number
  FROM lineitem),
quoted AS (
  SELECT *, greatest(floor(8e0 * cast(sum(CASE WHEN NOT scratched THEN pool END)
      OVER (PARTITION BY l_orderkey) AS double) / cast(pool AS double)) / 1e1, 1e0) AS raw_odds
  FROM lines),
ranked AS (
  SELECT *, cast(row_number() OVER (PARTITION BY l_orderkey, scratched
      ORDER BY raw_odds, horse_number) AS int) AS by_odds,
    cast(row_number() OVER (PARTITION BY l_orderkey, scratched
      ORDER BY l_quantity DESC, horse_number) AS int) AS by_finish
  FROM quoted),
joined AS (
  SELECT *, cast(1000 + 200 * (o_orderkey % 8) AS int) AS distance,
    cast(floor((1000 + 200 * (o_orderkey % 8)) * 57 / 100) + 50 - l_quantity AS int) AS tenths
  FROM ranked JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
runners AS (
  SELECT cast(o_orderkey AS varchar) AS race_id,
    replace(substr(cast(o_orderdate AS varchar), 1, 10), '-', '/') AS date_text,
    lpad(cast(o_custkey % 10 + 1 AS varchar), 2, '0') AS venue_code,
    distance,
    CASE WHEN o_orderkey % 3 = 0 THEN 'ダート' ELSE '芝' END AS surface,
    CASE o_orderstatus WHEN 'O' THEN '良' WHEN 'F' THEN '稍重' ELSE '重' END AS track_condition,
    concat('R', o_orderkey) AS race_name,
    CASE substr(o_orderpriority, 1, 1)
      WHEN '1' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'G1' ELSE 'GI' END
      WHEN '2' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'G2' ELSE 'GII' END
      WHEN '3' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'G3' ELSE 'GIII' END
      WHEN '4' THEN 'オープン' ELSE '3勝クラス' END AS race_class,
    horse_number, concat('H', l_partkey) AS horse_name, concat('J', l_suppkey) AS jockey_name,
    CASE WHEN NOT scratched THEN raw_odds END AS odds,
    CASE WHEN NOT scratched THEN by_odds END AS popularity,
    CASE WHEN NOT scratched THEN by_finish END AS finish_position,
    CASE WHEN scratched THEN NULL WHEN o_orderkey % 97 = 0 THEN ''
      WHEN o_orderkey % 89 = 0 THEN '中止'
      WHEN tenths < 600 THEN concat(tenths // 10, '.', tenths % 10)
      ELSE concat(tenths // 600, ':', lpad(cast((tenths % 600) // 10 AS varchar), 2, '0'),
                  '.', tenths % 10) END AS running_time,
    CASE WHEN NOT scratched THEN (330 + 5 * round(l_tax * 100)) / 1e1 END AS final_600m_time,
    (100 + round(l_discount * 100)) / 2e0 AS handicap,
    CASE l_partkey % 3 WHEN 0 THEN '牡' WHEN 1 THEN '牝' ELSE 'セ' END AS sex,
    cast(2 + l_partkey % 6 AS int) AS age,
    CASE WHEN (o_orderkey + l_partkey) % 7 <> 0 THEN cast(440 + l_partkey % 80 AS int) END AS weight,
    cast((o_orderkey + l_partkey) % 21 - 10 AS int) AS weight_change
  FROM joined),
results AS (SELECT * FROM runners WHERE odds IS NOT NULL),
scope AS (SELECT * FROM results WHERE venue_code = '06' AND distance = 1200 AND surface = '芝'),
"""

TARGETS = f"""targets AS (
  SELECT race_id, date_text FROM runners
  WHERE venue_code = '06' AND distance = 1200 AND surface = '芝' AND date_text >= '{CUTOFF}'
  GROUP BY race_id, date_text HAVING count(odds) >= 4),
entries AS (SELECT r.* REPLACE (cast(NULL AS double) AS odds), r.odds AS actual_odds
  FROM runners r JOIN targets USING (race_id)),
past AS (SELECT * FROM results WHERE date_text < '{CUTOFF}'),
"""


def _latest(alias: str = "") -> str:
    return f"{alias}date_text DESC, cast({alias}race_id AS bigint) DESC, {alias}horse_number"


def _features(source: str, prefix: str = "") -> str:
    """CTEs for the jockey, horse and combination features of ``source``, one table each."""
    recent = f"date_text >= '{WINDOW.recent_since}' AND surface = '芝'"
    p = prefix
    return f"""{p}jstat AS (
  SELECT jockey_name, avg(odds) AS jockey_avg_odds,
    avg(CASE WHEN finish_position = 1 THEN 1e0 WHEN finish_position IS NOT NULL THEN 0e0 END)
      AS jockey_win_rate, count(*) AS jockey_ride_count
  FROM {source} WHERE date_text >= '{WINDOW.jockey_since}'
  GROUP BY jockey_name HAVING count(*) > {WINDOW.min_rides}),
{p}alltime AS (
  SELECT horse_name, avg(finish_position) AS horse_avg_finish_pos,
    avg(popularity) AS horse_avg_popularity, avg(odds) AS horse_avg_odds,
    count(*) AS horse_race_count FROM {source} GROUP BY horse_name),
{p}class AS (
  SELECT horse_name, cast(max({GRADE}) AS int) AS horse_max_grade,
    cast(max(CASE WHEN {GRADE} = 4 AND finish_position <= 3 THEN 1 ELSE 0 END) AS int)
      AS horse_is_g1_performer FROM {source} GROUP BY horse_name),
{p}ordered AS (
  SELECT *, row_number() OVER (PARTITION BY horse_name ORDER BY {_latest()}) AS start
  FROM {source}),
{p}prev AS (
  SELECT horse_name, finish_position AS prev_finish_pos, popularity AS prev_popularity,
    odds AS prev_odds, jockey_name AS prev_jockey_name, handicap AS prev_handicap
  FROM {p}ordered WHERE start = 1),
{p}form AS (
  SELECT horse_name, avg(finish_position) AS horse_recent_3_avg_finish_pos
  FROM {p}ordered WHERE start <= 3 GROUP BY horse_name),
{p}speeds AS (
  SELECT horse_name, speed AS horse_recent_max_speed FROM (
    SELECT horse_name, speed, row_number() OVER (PARTITION BY horse_name
      ORDER BY abs(distance - 1200), speed DESC NULLS FIRST) AS place
    FROM (SELECT *, {SPEED} AS speed FROM {source} WHERE {recent})) WHERE place = 1),
{p}final600 AS (
  SELECT horse_name, avg(final_600m_time) AS horse_recent_avg_final_600m
  FROM {source} WHERE {recent} GROUP BY horse_name),
{p}venue AS (
  SELECT horse_name, avg(finish_position) AS horse_venue_avg_finish_pos
  FROM {source} WHERE venue_code = '06' GROUP BY horse_name),
{p}dist AS (
  SELECT horse_name, avg(finish_position) AS horse_dist_avg_finish_pos
  FROM {source} WHERE distance = 1200 AND surface = '芝' GROUP BY horse_name),
{p}firm AS (
  SELECT horse_name, avg(finish_position) AS horse_firm_avg_finish_pos
  FROM {source} WHERE surface = '芝' AND track_condition = '良' GROUP BY horse_name),
{p}hstat AS (
  SELECT * FROM {p}alltime LEFT JOIN {p}class USING (horse_name)
  LEFT JOIN {p}prev USING (horse_name) LEFT JOIN {p}speeds USING (horse_name)
  LEFT JOIN {p}final600 USING (horse_name) LEFT JOIN {p}venue USING (horse_name)
  LEFT JOIN {p}dist USING (horse_name) LEFT JOIN {p}firm USING (horse_name)
  LEFT JOIN {p}form USING (horse_name)),
{p}combo AS (
  SELECT horse_name, jockey_name, avg(finish_position) AS combo_avg_finish_pos
  FROM {source} GROUP BY horse_name, jockey_name),
"""


def _attached(rows: str, prefix: str = "") -> str:
    return f"""SELECT *, coalesce(handicap - prev_handicap, 0e0) AS handicap_diff,
    CASE WHEN jockey_name = prev_jockey_name THEN 0 ELSE 1 END AS jockey_changed
  FROM {rows} LEFT JOIN {prefix}jstat USING (jockey_name)
  LEFT JOIN {prefix}hstat USING (horse_name)
  LEFT JOIN {prefix}combo USING (horse_name, jockey_name)"""


# Columns that are whole numbers in the feature tables.
_WHOLE = {
    "horse_number", "age", "weight", "weight_change", "jockey_changed", "horse_max_grade",
    "horse_is_g1_performer", "prev_finish_pos", "prev_popularity", "jockey_ride_count",
    "prev_jockey_name", "horse_race_count",
}
_HORSE = (
    "horse_avg_finish_pos", "horse_avg_popularity", "horse_avg_odds", "horse_max_grade",
    "horse_is_g1_performer", "horse_recent_avg_final_600m", "horse_venue_avg_finish_pos",
    "horse_dist_avg_finish_pos", "horse_firm_avg_finish_pos", "horse_recent_3_avg_finish_pos",
    "horse_recent_max_speed", "prev_finish_pos", "prev_popularity", "prev_odds",
    "prev_jockey_name", "prev_handicap",
)
_JOCKEY = ("jockey_avg_odds", "jockey_win_rate", "jockey_ride_count")
_HISTORY_SIDE = tuple(
    f for f in FINAL_FEATURES
    if f not in ("horse_number", "handicap", "age", "weight", "weight_change", "handicap_diff",
                 "jockey_changed")
)


def _plain(columns) -> str:
    return ", ".join(c if c in _WHOLE else six(c) for c in columns)


def _filled(columns, value) -> str:
    return ", ".join(
        six(f"coalesce(cast({c} AS double), {value(c)})", c) if c in _HISTORY_SIDE else _plain([c])
        for c in columns
    )


SCORED = """means AS (
  SELECT horse_name, avg(odds) AS horse_avg_odds FROM results GROUP BY horse_name),
scored AS (SELECT *, 8e-1 / horse_avg_odds AS raw FROM results JOIN means USING (horse_name)),
"""


def _priced(k: str, rows: str = "scored") -> str:
    return f"""priced AS (
  SELECT *, raw ** {k} / sum(raw ** {k}) OVER (PARTITION BY race_id) * 8e-1 AS share,
    8e-1 / (raw ** {k} / sum(raw ** {k}) OVER (PARTITION BY race_id) * 8e-1) AS predicted
  FROM {rows})
"""


GRID = f"""ks AS (SELECT 1e0 + g * 1e-1 AS k FROM range({len(K_GRID)}) t(g)),
per_k AS (
  SELECT race_id, k, odds, 8e-1 / (raw ** k / sum(raw ** k) OVER (PARTITION BY race_id, k) * 8e-1)
    AS predicted FROM scored, ks),
per_race AS (
  SELECT race_id, k, sqrt(avg((ln(odds) - ln(predicted)) ** 2)) AS rmse
  FROM per_k GROUP BY race_id, k),
grid AS (SELECT k, avg(rmse) AS log_rmse FROM per_race GROUP BY k)
"""

DAY = "(cast(strptime(date_text, '%Y/%m/%d') AS date) - date '1970-01-01')"

# Every result row with the earlier starts of the same horse: the plain meaning of "so far".
ASOF_HORSE = f"""dated AS (
  SELECT *, {DAY} AS day, {SPEED} AS speed, {GRADE} AS grade FROM results),
asked AS (SELECT DISTINCT horse_name, day FROM dated),
seen AS (
  SELECT a.horse_name AS h, a.day AS d, s.*,
    row_number() OVER (PARTITION BY a.horse_name, a.day ORDER BY {_latest('s.')}) AS start,
    row_number() OVER (PARTITION BY a.horse_name, a.day,
        (s.surface = '芝' AND s.day >= a.day - {WINDOW.recent_days})
      ORDER BY abs(s.distance - 1200), s.speed DESC NULLS FIRST) AS place,
    (s.surface = '芝' AND s.day >= a.day - {WINDOW.recent_days}) AS recent
  FROM asked a JOIN dated s ON s.horse_name = a.horse_name AND s.day < a.day),
known AS (
  SELECT h AS horse_name, d AS day, avg(finish_position) AS horse_avg_finish_pos,
    avg(popularity) AS horse_avg_popularity, avg(odds) AS horse_avg_odds,
    cast(max(grade) AS int) AS horse_max_grade,
    cast(max(CASE WHEN grade = 4 AND finish_position <= 3 THEN 1 ELSE 0 END) AS int)
      AS horse_is_g1_performer,
    avg(final_600m_time) FILTER (recent) AS horse_recent_avg_final_600m,
    avg(finish_position) FILTER (venue_code = '06') AS horse_venue_avg_finish_pos,
    avg(finish_position) FILTER (distance = 1200 AND surface = '芝') AS horse_dist_avg_finish_pos,
    avg(finish_position) FILTER (surface = '芝' AND track_condition = '良')
      AS horse_firm_avg_finish_pos,
    avg(finish_position) FILTER (start <= 3) AS horse_recent_3_avg_finish_pos,
    max(speed) FILTER (recent AND place = 1) AS horse_recent_max_speed,
    max(finish_position) FILTER (start = 1) AS prev_finish_pos,
    max(popularity) FILTER (start = 1) AS prev_popularity,
    max(odds) FILTER (start = 1) AS prev_odds,
    max(jockey_name) FILTER (start = 1) AS prev_jockey_name,
    max(handicap) FILTER (start = 1) AS prev_handicap
  FROM seen GROUP BY h, d)
"""


def _backtest(point_in_time: bool, races: str) -> str:
    so_far = "AND s.day < a.day" if point_in_time else ""
    return f"""dated AS (SELECT *, {DAY} AS day FROM results),
asked AS (
  SELECT DISTINCT horse_name, {DAY} AS day FROM runners
  WHERE venue_code = '06' AND distance = 1200 AND surface = '芝'),
known AS (
  SELECT a.horse_name, a.day, avg(s.odds) AS horse_avg_odds
  FROM asked a JOIN dated s ON s.horse_name = a.horse_name {so_far} GROUP BY a.horse_name, a.day),
course AS (
  SELECT s.day, horse_avg_odds FROM (SELECT *, {DAY} AS day FROM scope) s
  LEFT JOIN known k ON k.horse_name = s.horse_name AND k.day = s.day),
fill AS (
  SELECT a.day, avg(c.horse_avg_odds) AS mean FROM (SELECT DISTINCT day FROM asked) a
  JOIN course c ON c.day < a.day GROUP BY a.day),
scored AS (
  SELECT r.*, 8e-1 / coalesce(horse_avg_odds, mean) AS raw
  FROM (SELECT *, {DAY} AS day FROM runners WHERE race_id IN ({races})) r
  LEFT JOIN known USING (horse_name, day) LEFT JOIN fill USING (day)),
{_priced('1.2e0').rstrip()},
errors AS (
  SELECT race_id, substr(date_text, 1, 4) AS year,
    sqrt(avg((ln(odds) - ln(predicted)) ** 2)) AS log_rmse
  FROM priced GROUP BY race_id, substr(date_text, 1, 4))
"""


def _done(ctes: str, select: str) -> str:
    return BASE + ctes.rstrip().rstrip(",") + "\n" + select


def _rows(select: str, source: str = "results") -> str:
    return _done("", f"SELECT race_id, horse_number, {select} FROM {source}")


_MEANS = ", ".join(f"coalesce(avg({f}), 0e0) AS {f}" for f in FINAL_FEATURES)
_SNAPSHOT = _features("results")
_PAST = TARGETS + _features("past")
_PREVIOUS = _done(
    TARGETS + _features("past"),
    "SELECT race_id, horse_number, {} FROM results LEFT JOIN prev USING (horse_name)",
)


def _table(name: str, columns: str) -> str:
    return _done(_SNAPSHOT, f"SELECT {columns} FROM {name}")


def _imputed(value) -> str:
    return "race_id, " + _filled(FINAL_FEATURES, value)


def _checked(share_sum: str) -> str:
    """What SQL can state of a model's prices."""
    return _done(
        TARGETS,
        f"SELECT race_id, count(*) AS runners, cast({share_sum} AS double) AS share_sum,"
        " true AS above_floor, true AS ordered_by_score FROM entries GROUP BY race_id",
    )


ORACLE = {
    "results_scan": _done("", """SELECT race_id, horse_number, horse_name, jockey_name,
      finish_position, popularity, """ + six("odds") + """, date_text, venue_code, handicap, distance,
      surface, track_condition, running_time, """ + six("final_600m_time") + """, race_name,
      race_class, weight, weight_change FROM results"""),
    "training_scope": _done("", """SELECT race_id, date_text, horse_number, horse_name, jockey_name,
      handicap, sex, age, """ + six("odds") + ", weight, weight_change FROM scope"),
    "cutoff_scan": _rows(
        "date_text, horse_name, jockey_name, " + six("odds"),
        f"results WHERE date_text < '{CUTOFF}'",
    ),
    "race_entries": _done(TARGETS, """SELECT race_id, date_text, horse_number, horse_name,
      jockey_name, handicap, sex, age, """ + six("actual_odds") + """, weight, weight_change
      FROM entries"""),
    "race_dates": _done(TARGETS, "SELECT race_id, date_text FROM targets"),
    "entry_list": _rows("horse_name, sex, age, handicap, jockey_name", "runners"),
    "feature_store_roundtrip": _done(_SNAPSHOT, "SELECT horse_name, jockey_name, "
      + _plain(("combo_avg_finish_pos", *_JOCKEY, *_HORSE))
      + " FROM combo LEFT JOIN jstat USING (jockey_name) LEFT JOIN hstat USING (horse_name)"),
    "prediction_report": _done(
        SCORED + "course AS (SELECT * FROM scored JOIN (SELECT DISTINCT race_id FROM scope)"
        " USING (race_id)),\n" + _priced("1.2e0", "course"),
        "SELECT race_id, horse_number, horse_name, jockey_name, "
        + six("greatest(predicted, 1e0)", "predicted_odds") + " FROM priced",
    ),
    "time_to_seconds": _rows("running_time, " + six(SECONDS, "time_secs")),
    "speed_mps": _rows(six(SPEED, "speed")),
    "race_grade": _rows(f"race_class, {GRADE} AS race_grade, {STRICT_GRADE} AS strict_grade"),
    "sex_age_split": _rows("concat(sex, age) AS token, sex, age", "runners"),
    "sex_encoding": _done(
        "codes AS (SELECT sex, cast(dense_rank() OVER (ORDER BY encode(sex)) - 1 AS int) AS code"
        " FROM (SELECT DISTINCT sex FROM scope))",
        "SELECT race_id, horse_number, sex, coalesce(code, 0) AS sex_encoded FROM runners"
        " LEFT JOIN codes USING (sex)",
    ),
    "handicap_diff": _PREVIOUS.format(
        "handicap, prev_handicap, coalesce(handicap - prev_handicap, 0e0) AS handicap_diff"
    ),
    "jockey_changed": _PREVIOUS.format(
        "jockey_name, prev_jockey_name,"
        " CASE WHEN jockey_name = prev_jockey_name THEN 0 ELSE 1 END AS jockey_changed"
    ),
    "weight_overlay": _rows(
        "coalesce(weight, 490) AS weight,"
        " CASE WHEN weight IS NULL THEN 0 ELSE weight_change END AS weight_change,"
        " weight AS announced_weight",
        "runners",
    ),
    "weight_scenario": _rows(
        "weight - weight_change AS weight, 0 AS weight_change", "runners"
    ),
    "implied_share": _rows(six("8e-1 / odds", "share")),
    "log_share": _rows(six("ln(8e-1 / odds)", "log_share")),
    "share_floor": _rows(
        six("greatest((8e-1 / odds) * (8e-1 / odds), 1e-3)", "floored") + ", "
        + six("greatest(8e-1 / odds, 1e-2)", "floored_higher")
    ),
    "odds_floor": _rows(
        ", ".join([
            six("greatest(odds / 2e0, 1.1e0)", "floor_11"),
            six("greatest(odds / 2e0, 1e0)", "floor_10"),
            six("odds / 2e0", "no_floor"),
        ])
    ),
    "power_calibration": _rows(
        ", ".join([
            six("8e-1 / odds", "k_10"),
            six("(8e-1 / odds) ** 1.2e0", "k_12"),
            six("(8e-1 / odds) ** 1.5e0", "k_15"),
        ])
    ),
    "impute_train_mean": _done(
        _SNAPSHOT + f"rows AS ({_attached('scope')}),\nmean AS (SELECT {_MEANS} FROM rows)",
        "SELECT race_id, " + ", ".join(
            six(f"coalesce(cast(rows.{f} AS double), mean.{f})", f) for f in FINAL_FEATURES
        ) + " FROM rows, mean",
    ),
    "impute_score_mean": _done(
        _PAST + "train AS (" + _attached(f"(SELECT * FROM scope WHERE date_text < '{CUTOFF}')")
        + f"),\nmean AS (SELECT {_MEANS} FROM train),\nrows AS ({_attached('entries')}),\n",
        "SELECT " + _imputed(lambda c: f"(SELECT mean.{c} FROM mean)") + " FROM rows",
    ),
    "impute_score_zero": _done(
        _PAST + f"rows AS ({_attached('entries')})",
        "SELECT " + _imputed(lambda c: "0e0") + " FROM rows",
    ),
    "horse_features": _table("hstat", "horse_name, horse_race_count, " + _plain(_HORSE)),
    "training_matrix": _done(
        _SNAPSHOT + f"rows AS ({_attached('scope')})",
        "SELECT race_id, horse_name, jockey_name, " + _plain(("odds", *FINAL_FEATURES))
        + " FROM rows",
    ),
    "entry_matrix": _done(
        _PAST + f"rows AS ({_attached('entries')})",
        "SELECT race_id, horse_name, jockey_name, " + _plain(("actual_odds", *FINAL_FEATURES))
        + " FROM rows",
    ),
    "jockey_stats": _table("jstat", "jockey_name, " + _plain(_JOCKEY)),
    "jockey_stats_min_rides": _done("", "SELECT jockey_name, "
        + six("avg(odds)", "jockey_avg_odds") + ", "
        + six("avg(cast(finish_position = 1 AS int))", "jockey_win_rate")
        + f""", count(*) AS jockey_ride_count FROM results
        WHERE date_text >= '{WINDOW.recent_since}' GROUP BY jockey_name HAVING count(*) > 150"""),
    "horse_alltime": _table(
        "alltime",
        "horse_name, horse_race_count, "
        + _plain(("horse_avg_finish_pos", "horse_avg_popularity", "horse_avg_odds")),
    ),
    "horse_class": _table("class", "*"),
    "combo_stats": _table("combo", "horse_name, jockey_name, " + six("combo_avg_finish_pos")),
    "final600_recent": _table("final600", "horse_name, " + six("horse_recent_avg_final_600m")),
    "venue_aptitude": _table("venue", "horse_name, " + six("horse_venue_avg_finish_pos")),
    "distance_aptitude": _table("dist", "horse_name, " + six("horse_dist_avg_finish_pos")),
    "going_aptitude": _table("firm", "horse_name, " + six("horse_firm_avg_finish_pos")),
    "previous_start": _table("prev", "horse_name, prev_finish_pos, prev_popularity, "
      + six("prev_odds") + ", prev_jockey_name, prev_handicap"),
    "recent3_form": _table("form", "horse_name, " + six("horse_recent_3_avg_finish_pos")),
    "nearest_speed": _table("speeds", "horse_name, " + six("horse_recent_max_speed")),
    "race_normalise": _done(
        SCORED + _priced("1e0"),
        "SELECT race_id, horse_number, " + six("share") + ", "
        + six("predicted", "predicted_odds") + " FROM priced",
    ),
    "price_race": _done(
        SCORED + _priced("1.2e0"),
        "SELECT race_id, horse_number, " + six("share") + ", "
        + six("greatest(predicted, 1e0)", "predicted_odds") + " FROM priced",
    ),
    "log_rmse": _done(
        SCORED + _priced("1.2e0"),
        "SELECT race_id, " + six("sqrt(avg((ln(odds) - ln(predicted)) ** 2))", "log_rmse")
        + " FROM priced GROUP BY race_id",
    ),
    "pred_vs_actual": _done(
        SCORED + _priced("1.2e0"),
        "SELECT race_id, horse_number, horse_name, "
        + six("greatest(predicted, 1e0)", "predicted_odds") + ", " + six("odds", "actual_odds")
        + " FROM priced",
    ),
    "backtest_baseline": _done(
        _backtest(True, "SELECT race_id FROM scope"),
        "SELECT race_id, year, " + six("log_rmse") + " FROM errors",
    ),
    "backtest_snapshot": _done(
        _backtest(False, "SELECT race_id FROM scope"),
        "SELECT race_id, year, " + six("log_rmse") + " FROM errors",
    ),
    "backtest_mean": _done(
        TARGETS + _backtest(True, "SELECT race_id FROM targets"),
        "SELECT " + six("avg(log_rmse)", "mean_log_rmse") + ", count(log_rmse) AS races FROM errors",
    ),
    "k_grid": _done(SCORED + GRID, f"SELECT {six('k')}, {six('log_rmse')} FROM grid"),
    "k_best": _done(
        SCORED + GRID,
        f"SELECT {six('k')}, {six('log_rmse')} FROM (SELECT * FROM grid ORDER BY log_rmse, k LIMIT 1)",
    ),
    "asof_horse_features": _done(
        ASOF_HORSE,
        "SELECT race_id, horse_number, " + _plain(_HORSE)
        + " FROM (SELECT race_id, horse_number, horse_name, day FROM dated)"
        " LEFT JOIN known USING (horse_name, day)",
    ),
    "asof_jockey_stats": _done(
        f"""dated AS (SELECT *, {DAY} AS day FROM results),
asked AS (SELECT DISTINCT jockey_name, day FROM dated),
known AS (
  SELECT a.jockey_name, a.day, avg(odds) AS jockey_avg_odds,
    avg(cast(finish_position = 1 AS int)) AS jockey_win_rate, count(*) AS jockey_ride_count
  FROM asked a JOIN dated s ON s.jockey_name = a.jockey_name
    AND s.day BETWEEN a.day - {WINDOW.jockey_days} AND a.day - 1
  GROUP BY a.jockey_name, a.day HAVING count(*) > {WINDOW.min_rides})""",
        "SELECT race_id, horse_number, " + _plain(_JOCKEY)
        + " FROM dated LEFT JOIN known USING (jockey_name, day)",
    ),
    "asof_combo_stats": _done(
        f"""dated AS (SELECT *, {DAY} AS day FROM results),
known AS (
  SELECT *, avg(finish_position) OVER (PARTITION BY horse_name, jockey_name ORDER BY day
    RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS combo_avg_finish_pos FROM dated)""",
        "SELECT race_id, horse_number, " + six("combo_avg_finish_pos") + " FROM known",
    ),
    "scratch_renormalise": _done(
        """means AS (
  SELECT horse_name, avg(odds) AS horse_avg_odds FROM results GROUP BY horse_name),
scored AS (SELECT *, 8e-1 / horse_avg_odds AS raw FROM runners JOIN means USING (horse_name)),
first AS (SELECT *, sum(raw) OVER (PARTITION BY race_id) / raw AS odds_before FROM scored),
after AS (SELECT *, raw / sum(raw) OVER (PARTITION BY race_id) * 8e-1 AS share FROM first
  WHERE odds IS NOT NULL)""",
        "SELECT race_id, horse_number, " + ", ".join(
            [six("odds_before"), six("share"), six("8e-1 / share", "predicted_odds")]
        ) + " FROM after",
    ),
    "log_loss": _done(
        SCORED + _priced("1.2e0"),
        "SELECT " + six(
            "sum(-ln(share / 8e-1)) / count(DISTINCT race_id)", "log_loss",
        ) + ", count(DISTINCT race_id) AS races FROM priced WHERE finish_position = 1",
    ),
    "value_return": _done(
        SCORED + _priced("1.2e0"),
        "SELECT substr(date_text, 1, 4) AS year, count(*) AS bets, "
        + six("sum(CASE WHEN finish_position = 1 THEN odds ELSE 0e0 END)", "returned") + ", "
        + six("avg(CASE WHEN finish_position = 1 THEN odds ELSE 0e0 END)", "return_rate")
        + " FROM priced WHERE share / 8e-1 * odds > 1 GROUP BY substr(date_text, 1, 4)",
    ),
    "checked_odds": _checked("NULL"),
    "checked_share": _checked("8e-1"),
    "checked_logshare": _checked("8e-1"),
    "checked_predictions": _checked("8e-1"),
    "checked_importance": "SELECT unnest([" + ", ".join(f"'{f}'" for f in FINAL_FEATURES)
    + "]) AS feature, 1e0 AS total",
    "checked_roundtrip": _done(
        TARGETS, "SELECT race_id, horse_number, true AS same FROM entries"
    ),
    "feature_vector": _done(
        _PAST + "train AS (" + _attached(f"(SELECT * FROM scope WHERE date_text < '{CUTOFF}')")
        + f"),\nmean AS (SELECT {_MEANS} FROM train),\nrows AS ({_attached('entries')}),\n",
        "SELECT race_id, " + ", ".join(
            six(f"coalesce(cast(rows.{f} AS double), "
                + (f"mean.{f}" if f in _HISTORY_SIDE else "0e0") + ")", f)
            for f in FINAL_FEATURES
        ) + " FROM rows, mean",
    ),
    "checked_backtest": _done(
        TARGETS, "SELECT race_id, substr(date_text, 1, 4) AS year, true AS scored FROM targets"
    ),
    "checked_param_search": _done(
        TARGETS,
        "SELECT parameters, true AS scored FROM (SELECT unnest([" + ", ".join(
            "'" + ", ".join(f"{k}={v}" for k, v in sorted(c.items())) + "'" for c in SEARCHED
        ) + "]) AS parameters) WHERE EXISTS (SELECT 1 FROM targets)",
    ),
}

ORACLE["stored_windows"] = ORACLE["jockey_stats_min_rides"]
ORACLE["evaluated_baseline"] = _done(
    SCORED + _priced("1.2e0"),
    "SELECT race_id, "
    + six("sqrt(avg((ln(odds) - ln(predicted)) ** 2))", "log_rmse")
    + " FROM priced GROUP BY race_id",
)
ORACLE["listed_backtest"] = ORACLE["backtest_mean"]
ORACLE["feature_store_in_steps"] = ORACLE["feature_store_roundtrip"]

# a grid a thousandth wide around the best point of the coarse one
ORACLE["k_refined"] = _done(
    SCORED + GRID + """, best AS (SELECT k FROM grid ORDER BY log_rmse, k LIMIT 1),
fine AS (SELECT best.k - 1e-1 + g * 1e-3 AS k FROM best, range(201) t(g) WHERE best.k - 1e-1 + g * 1e-3 >= 1e0),
fine_k AS (
  SELECT race_id, k, ln(odds) + k * ln(raw) - ln(sum(raw ** k) OVER (PARTITION BY race_id, k)) AS error
  FROM scored, fine),
fine_race AS (SELECT race_id, k, sqrt(avg(error ** 2)) AS rmse FROM fine_k GROUP BY race_id, k)
""",
    "SELECT round(k, 2) AS k, round(log_rmse, 5) AS log_rmse FROM (SELECT k, avg(rmse) AS log_rmse"
    " FROM fine_race GROUP BY k ORDER BY log_rmse, k LIMIT 1)",
)
