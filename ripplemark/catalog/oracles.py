"""SQL for another engine (DuckDB) that computes each query's result on its own way.

The SQL is written the plain, quadratic or textbook way where that differs from the Spark
job: known outcomes by an inequality join, regressions by elimination on sums over that
join, autocovariances by a self-join.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

DIGITS = 6
#: Columns compared by six significant digits.
SIGNIFICANT = ("p_value",)
ORACLES: dict[str, str] = {}


# --- output columns -----------------------------------------------------------------------------------


def f(expression: str, name: str | None = None, digits: int = DIGITS) -> str:
    if (name or expression) in SIGNIFICANT:
        return p(expression, name)
    near = f"round(CAST({expression} AS DOUBLE), {digits})"
    return f"CASE WHEN {near} = 0 THEN 0e0 ELSE {near} END AS {name or expression}"


def p(expression: str, name: str | None = None) -> str:
    return f"CASE WHEN {expression} IS NOT NULL THEN CAST(printf('%.5e', CAST({expression} AS DOUBLE)) AS DOUBLE) END AS {name or expression}"


def d(expression: str, name: str | None = None) -> str:
    return f"strftime({expression}, '%Y-%m-%d') AS {name or expression}"


def t(expression: str, name: str | None = None) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f') AS {name or expression}"


def i(expression: str, name: str | None = None) -> str:
    return f"CAST({expression} AS BIGINT) AS {name or expression}"


def floats(*names: str, digits: int = DIGITS) -> str:
    return ", ".join(f(name, digits=digits) for name in names)


def ints(*names: str) -> str:
    return ", ".join(i(name) for name in names)


def sql(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = f"WITH {ctes.strip().rstrip(',')}\n{select.strip()}"


# --- ticks and sessions -----------------------------------------------------------------------------------


def local(ts: str) -> str:
    return f"({ts} AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')"


def label(ts: str) -> str:
    return f"CAST({local(ts)} + INTERVAL 7 HOURS AS DATE)"


def closes(day: str) -> str:
    return f"((CAST({day} AS TIMESTAMP) + INTERVAL 17 HOURS) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC')"


def opens(day: str) -> str:
    return closes(f"({day} - INTERVAL 1 DAY)")


def hours(first: str, last: str) -> str:
    return f"((epoch_us({last}) - epoch_us({first})) / 3.6e9)"


ALL_TICKS = f"""
all_ticks AS (
  SELECT event_type AS asset, ts, value AS mid, event_id, {label('ts')} AS session_date FROM events
)"""
TICKS = ALL_TICKS + """,
ticks AS (SELECT * FROM all_ticks WHERE mid > 0 AND isfinite(mid) AND ts IS NOT NULL)"""


def bins(minutes: int, source: str = "ticks", name: str = "bins") -> str:
    step = minutes * 60_000_000
    if 1440 % minutes == 0:
        anchored = f"SELECT *, 0 AS anchor FROM {source}"
    else:
        anchored = (
            f"SELECT *, epoch_us(date_trunc('day', min(ts) OVER (PARTITION BY asset, session_date))) AS anchor"
            f" FROM {source}"
        )
    return f"""
{name}_raw AS ({anchored}),
{name} AS (
  SELECT asset, session_date,
         make_timestamp(anchor + (epoch_us(ts) - anchor) // {step} * {step}) AS bin,
         last(mid ORDER BY ts, event_id) AS mid, min(ts) AS first_ts, max(ts) AS last_ts
  FROM {name}_raw GROUP BY 1, 2, 3
)"""


def returns(source: str = "bins", name: str = "rets") -> str:
    path = "PARTITION BY asset, session_date ORDER BY bin"
    return f"""
{name}_lp AS (
  SELECT *, ln(mid) AS lp, row_number() OVER ({path}) AS k FROM {source}
),
{name} AS (SELECT *, lp - lag(lp) OVER ({path}) AS r FROM {name}_lp)"""


SUMMARY = """
summary AS (
  SELECT asset, session_date, count(*) AS observation_count, 0 AS n_invalid, sum(r * r) AS rv,
         CASE WHEN count(*) > 1 THEN coalesce(sum(r * r) FILTER (r > 0), 0) END AS rs_pos,
         CASE WHEN count(*) > 1 THEN coalesce(sum(r * r) FILTER (r < 0), 0) END AS rs_neg,
         min(first_ts) AS first_ts, max(last_ts) AS last_ts
  FROM rets GROUP BY 1, 2
)"""


def complete(min_hours: float, edges: bool, summary: str = "summary", name: str = "daily") -> str:
    edge = f"""
  WHERE NOT (session_date = first_day AND {hours(opens('session_date'), 'starts')} > 1)
    AND NOT (session_date = last_day AND {hours('ends', closes('session_date'))} > 1)""" if edges else ""
    return f"""
{name}_spans AS (
  SELECT *, min(first_ts) OVER (PARTITION BY asset) AS starts, max(last_ts) OVER (PARTITION BY asset) AS ends
  FROM {summary}
),
{name}_kept AS (
  SELECT *, min(session_date) OVER (PARTITION BY asset) AS first_day, max(session_date) OVER (PARTITION BY asset) AS last_day
  FROM {name}_spans
  WHERE {hours('first_ts', 'last_ts')} >= {min_hours} AND rv > 0 AND rs_pos > 0 AND rs_neg > 0
),
{name} AS (
  SELECT asset, session_date AS date, rv, rs_pos, rs_neg, ln(rv) AS log_rv, ln(rs_pos) AS log_rs_pos,
         ln(rs_neg) AS log_rs_neg, observation_count
  FROM {name}_kept{edge}
)"""


DAILY = ",".join([TICKS, bins(60), returns(), SUMMARY, complete(12, True)])
DAILY_SELECT = (
    f"SELECT asset, {d('date')}, {floats('rv', 'rs_pos', 'rs_neg', 'log_rv', 'log_rs_pos', 'log_rs_neg')},"
    f" {i('observation_count')} FROM "
)

sql("session_labels", ALL_TICKS, f"SELECT {i('event_id')}, asset, {d('session_date')} FROM all_ticks")
sql(
    "session_bounds", ALL_TICKS,
    f"SELECT DISTINCT {d('session_date')}, {t(opens('session_date'), 'opens')}, {t(closes('session_date'), 'closes')} FROM all_ticks",
)
BIN_SELECT = f"SELECT asset, {d('session_date')}, {t('bin')}, {f('mid')}, {t('first_ts')}, {t('last_ts')} FROM bins"
sql("last_tick_bins", ",".join([TICKS, bins(60)]), BIN_SELECT)
sql("last_tick_bins_anchored", ",".join([TICKS, bins(35)]), BIN_SELECT)
sql(
    "full_sessions", TICKS,
    f"SELECT asset, {d('session_date')}, {i('count(*)', 'ticks')} FROM ticks GROUP BY asset, session_date"
    f" HAVING {hours('min(ts)', 'max(ts)')} >= 23",
)
sql(
    "session_summary", ",".join([TICKS, bins(60), returns(), SUMMARY]),
    f"SELECT asset, {d('session_date')}, {ints('observation_count', 'n_invalid')}, {floats('rv', 'rs_pos', 'rs_neg')},"
    f" {t('first_ts')}, {t('last_ts')} FROM summary",
)
sql("daily_rv", DAILY, DAILY_SELECT + "daily")
sql("daily_rv_all_edges", ",".join([TICKS, bins(30), returns(), SUMMARY, complete(5, False)]), DAILY_SELECT + "daily")


def _part(name: str, rule: str) -> str:
    summary = SUMMARY.replace("summary AS", f"summary_{name} AS").replace("FROM rets", f"FROM rets_{name}")
    return ",".join(
        [
            f"\nticks_{name} AS (SELECT * FROM ticks WHERE {rule})",
            bins(60, f"ticks_{name}", f"bins_{name}"), returns(f"bins_{name}", f"rets_{name}"), summary,
            complete(2, False, f"summary_{name}", f"daily_{name}"),
        ]
    )


sql(
    "merged_sessions",
    ",".join(
        [
            TICKS, _part("early", "ts < TIMESTAMP '2024-01-17 09:00:00'"),
            _part("late", "ts >= TIMESTAMP '2024-01-15 03:00:00'"),
            """
copies AS (
  SELECT *, row_number() OVER (PARTITION BY asset, date ORDER BY observation_count DESC, rv DESC) AS copy
  FROM (SELECT * FROM daily_early UNION ALL SELECT * FROM daily_late)
)""",
        ]
    ),
    DAILY_SELECT + "copies WHERE copy = 1",
)
YEARLY = "(count(*) - 1) / (date_diff('day', min(date), max(date)) / 365.25e0)"
sql("sessions_per_year", DAILY, f"SELECT asset, {f(YEARLY, 'sessions_per_year')} FROM daily GROUP BY asset")
sql(
    "pair_names", ALL_TICKS,
    f"""SELECT asset, {i('count(*)', 'ticks')},
       CASE WHEN length(asset) = 6 THEN substr(asset, 1, 3) || '/' || substr(asset, 4, 3) ELSE asset END AS pair
FROM all_ticks GROUP BY asset""",
)

# --- tick tables ---------------------------------------------------------------------------------------------

QUOTES = ALL_TICKS + """,
quotes AS (
  SELECT *, mid * (1 - 1e-4 * (event_id % 7 - 1)) AS bid, mid * (1 - 1e-4 * (event_id % 5 - 2)) AS ask FROM all_ticks
)"""
sql(
    "tick_sanity",
    QUOTES + """,
ordered AS (
  SELECT *, (ask - bid) / nullif(mid, 0) * 1e4 AS bps, ts < lag(ts) OVER (PARTITION BY asset ORDER BY event_id) AS back
  FROM quotes
)""",
    f"""SELECT asset, {i('count(*)', 'ticks')}, {t('min(ts)', 'first_ts')}, {t('max(ts)', 'last_ts')},
       {i('count(*) FILTER (ask < bid)', 'crossed_quotes')}, {i('count(*) FILTER (mid <= 0)', 'non_positive_prices')},
       {f('quantile_cont(bps, 0.5)', 'spread_median')}, {f('quantile_cont(bps, 0.99)', 'spread_p99')},
       {i('count(*) FILTER (back)', 'unsorted')}
FROM ordered GROUP BY asset""",
)
sql(
    "tick_violations", ALL_TICKS,
    f"""SELECT asset, {i('count(*)', 'ticks')},
       {i('count(*) FILTER (NOT coalesce(ts IS NOT NULL AND isfinite(mid) AND mid > 0, false))', 'invalid')}
FROM all_ticks GROUP BY asset""",
)
sql(
    "tick_file_order", ALL_TICKS,
    f"""SELECT asset, 'events.parquet' AS file_name, {t('min(ts)', 'first_ts')}, {t('max(ts)', 'last_ts')},
       {i('count(*)', 'ticks')}, {i('0', 'out_of_order')} FROM all_ticks GROUP BY asset""",
)
sql(
    "expected_hours_missing",
    ALL_TICKS + """,
present AS (SELECT DISTINCT asset, date_trunc('hour', ts) AS hour FROM all_ticks),
ranges AS (SELECT asset, CAST(min(hour) AS DATE) AS a, CAST(max(hour) AS DATE) AS z FROM present GROUP BY asset),
grid AS (
  SELECT asset, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP) + INTERVAL 23 HOURS, INTERVAL 1 HOUR)) AS hour
  FROM ranges
)""",
    f"""SELECT asset, {t('hour')}, {i("hour + INTERVAL 25 HOURS <= TIMESTAMP '2024-01-31 12:00:00'", 'settled')}
FROM grid ANTI JOIN present USING (asset, hour) WHERE dayofweek(hour) <> 6""",
)
sql("assembled_ticks", QUOTES, f"SELECT {i('event_id')}, asset, {f('0.5e0 * (bid + ask)', 'mid', 9)} FROM quotes")

SYMBOL = """CASE asset WHEN 'click' THEN 'EURUSD' WHEN 'signup' THEN 'EURUSD' WHEN 'error' THEN 'USDJPY'
  WHEN 'purchase' THEN 'XAUUSD' WHEN 'view' THEN 'USA500IDXUSD' END"""
sql(
    "decoded_hours",
    ALL_TICKS + f""",
points AS (
  SELECT *, {SYMBOL} AS symbol, CAST(round(mid * 100) AS BIGINT) * 10 AS bid_points,
         CAST(round(mid * 100) AS BIGINT) * 10 + event_id % 7 AS ask_points,
         CASE WHEN {SYMBOL} = 'EURUSD' THEN 1e5 ELSE 1e3 END AS divider FROM all_ticks
)""",
    f"""SELECT symbol AS asset, {t("date_trunc('millisecond', ts)", 'ts')}, {f('bid_points / divider', 'bid', 9)},
       {f('ask_points / divider', 'ask', 9)}, {f('event_id % 8 / 2', 'bid_vol', 9)}, {f('event_id % 16 / 4', 'ask_vol', 9)},
       {f('(bid_points + ask_points) / divider / 2', 'mid', 9)} FROM points""",
)
ORACLES["landed_ticks"] = ORACLES["decoded_hours"]
sql("daily_table", DAILY, DAILY_SELECT + "daily")
sql("daily_table_appended", DAILY, DAILY_SELECT + "daily")
sql("daily_table_of_one_asset", DAILY, DAILY_SELECT.replace("asset", "upper(asset) AS asset", 1) + "daily WHERE asset = 'purchase'")
sql("stream_daily_table", DAILY, DAILY_SELECT + "daily")

# --- variance measures --------------------------------------------------------------------------------------

PATHS = ",".join([TICKS, bins(30), returns()])
PATH_HEAD = f"SELECT asset, {d('session_date')}, {i('count(*)', 'n_prices')}, {i('0', 'n_invalid')}"
BY_PATH = "GROUP BY asset, session_date"
BIPOWER = "CASE WHEN count(*) >= 3 THEN pi() / 2 * count(r) / (count(r) - 1) * sum(abs(r) * abs(r1)) END"
LAGGED = """
lagged AS (
  SELECT *, lag(r, 1) OVER w AS r1, lag(r, 2) OVER w AS r2, lag(r, 3) OVER w AS r3, lag(r, 4) OVER w AS r4
  FROM rets WINDOW w AS (PARTITION BY asset, session_date ORDER BY bin)
)"""
sql("realized_variance", PATHS, f"{PATH_HEAD}, {f('sum(r * r)', 'rv')} FROM rets {BY_PATH}")
_RAW = ",".join([ALL_TICKS, bins(5, "all_ticks", "raw_bins")])
sql(
    "variance_of_raw_paths",
    _RAW + """,
raw_priced AS (
  SELECT *, coalesce(mid > 0 AND isfinite(mid), false) AS good, CASE WHEN mid > 0 AND isfinite(mid) THEN ln(mid) END AS lp FROM raw_bins
),
raw_returns AS (SELECT *, lp - lag(lp) OVER (PARTITION BY asset, session_date ORDER BY bin) AS r FROM raw_priced)""",
    f"""SELECT asset, {d('session_date')}, {i('count(*)', 'n_prices')}, {i('count(*) FILTER (NOT good)', 'n_invalid')},
       {f('CASE WHEN bool_and(good) THEN sum(r * r) END', 'rv')} FROM raw_returns {BY_PATH}""",
)
sql(
    "semivariances", ",".join([PATHS, SUMMARY]),
    f"SELECT asset, {d('session_date')}, {i('observation_count', 'n_prices')}, {i('n_invalid')}, {floats('rs_pos', 'rs_neg')} FROM summary",
)
sql("bipower", ",".join([PATHS, LAGGED]), f"{PATH_HEAD}, {f(BIPOWER, 'bipower')} FROM lagged {BY_PATH}")
sql(
    "jump_rv_minus_bv", ",".join([PATHS, LAGGED]),
    f"{PATH_HEAD}, {f('sum(r * r)', 'rv')}, {f(BIPOWER, 'bipower')}, {f(f'sum(r * r) - {BIPOWER}', 'jump')} FROM lagged {BY_PATH}",
)
sql(
    "subsampled_rv",
    PATHS + """,
offsets AS (
  SELECT asset, session_date, (k - 1) % 3 AS o, lp, k,
         lp - lag(lp) OVER (PARTITION BY asset, session_date, (k - 1) % 3 ORDER BY k) AS step_return
  FROM rets
),
grids AS (
  SELECT asset, session_date, o, count(*) AS n, coalesce(sum(step_return * step_return), 0) AS grid_rv
  FROM offsets GROUP BY 1, 2, 3
)""",
    f"""SELECT asset, {d('session_date')}, {i('sum(n)', 'n_prices')}, {i('0', 'n_invalid')},
       {f('CASE WHEN sum(n) >= 6 THEN avg(grid_rv) END', 'subsampled_rv')} FROM grids {BY_PATH}""",
)
KERNEL = "sum(r * r) + " + " + ".join(
    f"2e0 * {weight} * sum(r * r{h})"
    # Parzen weights at 1/5 .. 4/5, by hand: 1 - 6 x^2 + 6 x^3 up to a half, 2 (1 - x)^3 beyond
    for h, weight in ((1, "(1e0 - 6e0 / 25 + 6e0 / 125)"), (2, "(1e0 - 24e0 / 25 + 48e0 / 125)"), (3, "(16e0 / 125)"), (4, "(2e0 / 125)"))
)
sql(
    "realized_kernel", ",".join([PATHS, LAGGED]),
    f"{PATH_HEAD}, {f(f'CASE WHEN count(*) >= 6 THEN {KERNEL} END', 'realized_kernel')} FROM lagged {BY_PATH}",
)


def bandwidth(ratio: str, n: str) -> str:
    # fixed value: (144 / 0.269)^(1/5)
    return f"ceil(power(144e0 / 269e-3, 2e-1) * power({ratio}, 4e-1) * power({n}, 6e-1))"


def upper_tail(z: str) -> str:
    """1 - Phi by Simpson's rule on exp(-|z| t - t^2 / 2), which keeps its digits far out."""
    at = f"exp(-abs({z}) * (k / 400e0) - power(k / 400e0, 2) / 2)"
    rule = f"list_sum([{at} * (CASE WHEN k IN (0, 4800) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) for k in range(0, 4801)]) / 1200e0"
    far = f"(exp(-power({z}, 2) / 2) / sqrt(2 * pi()) * {rule})"
    return f"(CASE WHEN {z} IS NULL THEN NULL WHEN {z} >= 0 THEN {far} ELSE 1e0 - {far} END)"


sql(
    "kernel_own_bandwidth",
    PATHS + f""",
sized AS (
  SELECT asset, session_date, count(*) AS n, CASE WHEN count(*) > 1 THEN {bandwidth('0.01e0', 'count(*) - 1')} END AS h
  FROM rets {BY_PATH}
),
gammas AS (
  SELECT a.asset, a.session_date, a.k - b.k AS lag, sum(a.r * b.r) AS gamma
  FROM rets a JOIN rets b ON a.asset = b.asset AND a.session_date = b.session_date AND a.k >= b.k
  WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2, 3
),
weights AS (
  SELECT s.asset, s.session_date, s.n, s.h, g.gamma, g.lag, g.lag / (s.h + 1) AS x
  FROM sized s LEFT JOIN gammas g ON g.asset = s.asset AND g.session_date = s.session_date AND g.lag <= s.h
)""",
    f"""SELECT asset, {d('session_date')}, {i('n', 'n_prices')}, {i('0', 'n_invalid')},
       {f('''CASE WHEN h < n - 1 THEN sum(gamma * CASE WHEN lag = 0 THEN 1 ELSE 2 * CASE
           WHEN x <= 0.5 THEN 1 - 6 * x * x + 6 * x * x * x ELSE 2 * power(1 - x, 3) END END) END''', 'realized_kernel')},
       {i('h', 'bandwidth')}
FROM weights GROUP BY asset, session_date, n, h""",
)
sql(
    "parzen_bandwidths", ",".join([TICKS, bins(30)]),
    f"""SELECT asset, {d('session_date')}, {i('count(*) - 1', 'n_returns')},
       {i(f"CASE WHEN count(*) > 1 THEN {bandwidth('min(mid) / max(mid)', '(count(*) - 1)')} END", 'bandwidth')}
FROM bins {BY_PATH}""",
)


def _frequencies(choices: dict[str, int]) -> tuple[str, str]:
    parts, unions = [TICKS], []
    for name, minutes in choices.items():
        parts += [bins(minutes, name=f"bins_{name}"), returns(f"bins_{name}", f"rets_{name}")]
        unions.append(
            f"SELECT asset, session_date, '{name.strip('_')}' AS frequency, sum(r * r) AS rv FROM rets_{name} GROUP BY 1, 2"
        )
    return ",".join(parts), "\nby_frequency AS (" + " UNION ALL ".join(unions) + ")"


_parts, _union = _frequencies({"30min": 30, "1h": 60, "2h": 120, "35min": 35})
sql("variance_by_frequency", f"{_parts},{_union}", f"SELECT asset, {d('session_date')}, frequency, {f('rv')} FROM by_frequency")
_parts, _union = _frequencies({"15min": 15, "30min": 30, "1h": 60, "2h": 120, "4h": 240})
sql(
    "signature", f"{_parts},{_union}",
    f"SELECT asset, frequency, {f('avg(rv)', 'mean_rv')}, {i('count(rv)', 'paths')} FROM by_frequency GROUP BY asset, frequency",
)
sql("annualized_volatility", DAILY, f"SELECT asset, {d('date')}, {f('100 * sqrt(365.25e0 * rv)', 'vol')} FROM daily")

# --- features and targets -----------------------------------------------------------------------------------

SALES = """
sales AS (
  SELECT l_returnflag AS series, CAST(l_shipdate AS DATE) AS date, ln(sum(l_extendedprice)) AS value,
         ln(sum(CASE WHEN l_discount > 0.05 THEN l_extendedprice ELSE 0 END) + 1) AS rise,
         ln(sum(CASE WHEN l_discount > 0.05 THEN 0 ELSE l_extendedprice END) + 1) AS fall
  FROM lineitem GROUP BY 1, 2
)"""
MEANS = """
timeline AS (
  SELECT *, lead(date) OVER s AS target_date, lead(value) OVER s AS target, row_number() OVER s AS pos,
         value AS value_mean_1,
         avg(value) OVER (PARTITION BY series ORDER BY date ROWS 4 PRECEDING) AS value_mean_5,
         avg(value) OVER (PARTITION BY series ORDER BY date ROWS 21 PRECEDING) AS value_mean_22,
         rise AS rise_mean_1, fall AS fall_mean_1
  FROM sales WINDOW s AS (PARTITION BY series ORDER BY date)
)"""
ORIGIN = d("date", "origin_date")
HAR_NAMES = ("value_mean_1", "value_mean_5", "value_mean_22")
SHAR_NAMES = ("rise_mean_1", "fall_mean_1", "value_mean_5", "value_mean_22")
TIMELINE = SALES + "," + MEANS
sql("trailing_means", TIMELINE, f"SELECT series, {ORIGIN}, {floats(*HAR_NAMES)} FROM timeline WHERE pos >= 22")
sql("full_timeline_features", SALES, f"SELECT series, {ORIGIN} FROM sales")
sql("next_targets", TIMELINE, f"SELECT series, {ORIGIN}, {d('target_date')}, {f('target')} FROM timeline")
WIDE = (*HAR_NAMES, "rise_mean_1", "fall_mean_1")
sql("join_features", TIMELINE, f"SELECT series, {ORIGIN}, {floats(*WIDE)} FROM timeline WHERE pos >= 22")
sql(
    "forecast_table", TIMELINE,
    f"SELECT series, {ORIGIN}, {d('target_date')}, {floats(*WIDE, 'target')} FROM timeline WHERE pos >= 22 AND target IS NOT NULL",
)
sql(
    "forecast_table_custom", TIMELINE,
    f"SELECT series, {ORIGIN}, {d('target_date')}, {floats(*HAR_NAMES)}, {f('dayofweek(date) + 1', 'weekday')}, {f('target')}"
    " FROM timeline WHERE pos >= 22 AND target IS NOT NULL",
)
sql(
    "prepared_with_missing_features", TIMELINE,
    f"SELECT series, {ORIGIN}, {d('target_date')}, {floats(*HAR_NAMES, 'target')}"
    " FROM timeline WHERE pos >= 22 AND target IS NOT NULL AND dayofweek(date) <> 3",
)
GAPS = SALES + """,
gaps AS (
  SELECT series, date, lag(date) OVER (PARTITION BY series ORDER BY date) AS previous_date FROM sales
),
sized AS (SELECT *, date_diff('day', previous_date, date) AS gap_days FROM gaps)"""
sql("gaps", GAPS, f"SELECT series, {d('date')}, {d('previous_date')}, {f('gap_days')} FROM sized")
sql(
    "large_gaps", GAPS,
    f"""SELECT series, {f('arg_min(gap_days, date)', 'gap_days')}, {d('arg_min(previous_date, date)', 'gap_start')},
       {d('min(date)', 'gap_end')}, {i('count(*)', 'large_gaps')} FROM sized WHERE gap_days > 1 GROUP BY series""",
)
sql(
    "observation_violations", SALES,
    f"""SELECT series, {i('0', 'missing')}, {i('sum(CASE WHEN dom = 7 THEN n ELSE 0 END)', 'not_finite')},
       {i('sum(CASE WHEN dom <> 7 AND value < 11 THEN n ELSE 0 END)', 'low')}, {i('count(*) FILTER (dom = 20)', 'repeated')}
FROM (SELECT *, day(date) AS dom, CASE WHEN day(date) = 20 THEN 2 ELSE 1 END AS n FROM sales) GROUP BY series""",
)
sql(
    "unmatched_origins", TIMELINE,
    f"""SELECT series, {i('count(*)', 'unmatched')}, {d('min(date)', 'first_origin')}
FROM timeline WHERE pos >= 22 AND day(date) = 11 GROUP BY series""",
)
_DAY = "day(origin_date)"
sql(
    "preparation_violations",
    TIMELINE + f""",
given AS (SELECT series, date AS origin_date, target_date, target, pos >= 22 AS has_features FROM timeline),
features AS (
  SELECT series, CASE WHEN {_DAY} <> 5 THEN origin_date END AS o, {_DAY} = 3 AS bad FROM given WHERE has_features
  UNION ALL SELECT series, origin_date, false FROM given WHERE has_features AND {_DAY} = 8
),
targets AS (
  SELECT series, origin_date AS o, CASE {_DAY} WHEN 16 THEN origin_date WHEN 18 THEN target_date + 1 ELSE target_date END AS t,
         CASE {_DAY} WHEN 13 THEN NULL WHEN 14 THEN CASE WHEN target IS NULL THEN 'infinity' :: DOUBLE ELSE 'infinity' :: DOUBLE END
         ELSE target END AS v FROM given WHERE {_DAY} <> 11
  UNION ALL SELECT series, origin_date, target_date, target FROM given WHERE {_DAY} = 20
),
in_features AS (
  SELECT series, count(*) FILTER (o IS NULL) AS feature_keyless, count(*) FILTER (bad) AS feature_not_finite,
         count(o) - count(DISTINCT o) AS feature_repeated,
         count(*) FILTER (o IS NOT NULL AND NOT EXISTS (SELECT 1 FROM targets t WHERE t.series = f.series AND t.o = f.o)) AS unmatched,
         min(o) FILTER (NOT EXISTS (SELECT 1 FROM targets t WHERE t.series = f.series AND t.o = f.o)) AS first_unmatched
  FROM features f GROUP BY series
),
followed AS (SELECT x.*, (SELECT min(y.o) FROM targets y WHERE y.series = x.series AND y.o > x.o) AS following FROM targets x),
in_targets AS (
  SELECT series, 0 AS target_keyless, count(*) FILTER ((t IS NULL) <> (v IS NULL)) AS target_half,
         count(*) FILTER (NOT isfinite(v)) AS target_not_finite, count(*) FILTER (o >= t) AS target_not_after,
         count(*) FILTER (t IS DISTINCT FROM following) AS target_not_next, count(o) - count(DISTINCT o) AS target_repeated
  FROM followed GROUP BY series
)""",
    f"""SELECT series, {ints('feature_keyless', 'feature_not_finite', 'feature_repeated', 'target_keyless', 'target_half',
       'target_not_finite', 'target_not_after', 'target_not_next', 'target_repeated', 'unmatched')}, {d('first_unmatched')}
FROM in_features JOIN in_targets USING (series)""",
)

# --- forecasts: known outcomes by an inequality join, regressions by elimination --------------------------

#: Columns are taken relative to this level, so that sums of squares keep their digits.
LEVEL = "13e0"
DATA = TIMELINE + f""",
data AS (
  SELECT series, date AS origin_date, target_date, target, target - {LEVEL} AS y,
         value_mean_1 - {LEVEL} AS x1, value_mean_5 - {LEVEL} AS x2, value_mean_22 - {LEVEL} AS x3,
         rise_mean_1 - {LEVEL} AS x4, fall_mean_1 - {LEVEL} AS x5
  FROM timeline WHERE pos >= 22 AND target IS NOT NULL
)"""
ALL_X = (1, 2, 3, 4, 5)


def moments(used: tuple[int, ...] = ALL_X, rule: str = "true", name: str = "known") -> str:
    """Sums over the outcomes known at each origin that satisfies ``rule``."""
    sums = ["count(*) AS n", "sum(e.y) AS sy", "sum(e.y) / count(*) AS my"]
    for a in used:
        sums += [f"sum(e.x{a}) / count(*) AS m{a}", f"sum(e.x{a} * e.y) AS p{a}y"]
    sums += [f"sum(e.x{a} * e.x{b}) AS p{a}{b}" for a, b in combinations_with_replacement(used, 2)]
    xs = "".join(f", any_value(q.x{a}) AS x{a}" for a in used)
    return f"""
{name} AS (
  SELECT q.series, q.origin_date, any_value(q.target_date) AS target_date, any_value(q.target) AS target{xs},
         {", ".join(sums)}
  FROM data q JOIN data e ON e.series = q.series AND e.target_date <= q.origin_date
  WHERE {rule} GROUP BY q.series, q.origin_date HAVING count(*) >= 252
)"""


def eliminate(columns: tuple[int, ...], source: str, name: str, ridge: str = "0") -> str:
    """CTEs that solve the centered normal equations of each row; ``name`` adds b<column>."""
    size = len(columns)
    low = {a: k for k, a in enumerate(columns)}

    def product(a: int, b: int) -> str:
        first, second = sorted((a, b))
        return f"(p{first}{second} - n * m{a} * m{b}{f' + {ridge}' if a == b else ''})"

    cells = [f"{product(a, b)} AS g{low[a]}_{low[b]}" for a in columns for b in columns]
    cells += [f"(p{a}y - n * m{a} * my) AS g{low[a]}_{size}" for a in columns]
    steps = [f"\n{name}_0 AS (SELECT *, {', '.join(cells)} FROM {source})"]
    for pivot in range(size):
        changed = [
            f"g{row}_{col} - g{row}_{pivot} / g{pivot}_{pivot} * g{pivot}_{col} AS g{row}_{col}"
            for row in range(size) if row != pivot for col in range(pivot, size + 1)
        ]
        replace = ", ".join(changed)
        body = f"SELECT * REPLACE ({replace}) FROM {name}_{pivot}" if changed else f"SELECT * FROM {name}_{pivot}"
        steps.append(f"\n{name}_{pivot + 1} AS ({body})")
    slopes = ", ".join(f"g{k}_{size} / g{k}_{k} AS b{a}" for a, k in low.items())
    steps.append(f"\n{name} AS (SELECT *, {slopes} FROM {name}_{size})")
    return ",".join(steps)


def predicted(columns: tuple[int, ...]) -> str:
    return f"{LEVEL} + my + " + " + ".join(f"b{a} * (x{a} - m{a})" for a in columns)


def ewma(source: str = "known") -> str:
    return f"""
ranked AS (
  SELECT series, target_date, y, row_number() OVER (PARTITION BY series ORDER BY target_date) AS k FROM data
),
ewma AS (
  SELECT q.series, q.origin_date,
         {LEVEL} + sum(e.y * CASE WHEN e.k = 1 THEN power(0.94e0, q.n - 1) ELSE 0.06e0 * power(0.94e0, q.n - e.k) END) AS predicted
  FROM {source} q JOIN ranked e ON e.series = q.series AND e.k <= q.n GROUP BY 1, 2
)"""


NAIVE = """
naive AS (
  SELECT q.series, q.origin_date, arg_max(e.target, e.target_date) AS predicted
  FROM known q JOIN data e ON e.series = q.series AND e.target_date <= q.origin_date GROUP BY 1, 2
)"""


def forecast_rows(model: str, source: str, value: str) -> str:
    return (
        f"SELECT '{model}' AS model, series, origin_date, target_date, target AS actual, {value} AS predicted, n AS n_train"
        f" FROM {source}"
    )


WF_SELECT = f"SELECT model, series, {d('origin_date')}, {d('target_date')}, {floats('actual', 'predicted')}, {i('n_train')} FROM "


def forecasts(name: str, ctes: str, *rows: str) -> None:
    sql(name, f"{ctes},\nforecasts AS ({' UNION ALL '.join(rows)})", WF_SELECT + "forecasts")


HAR_X, AR_X, SHAR_X = (1, 2, 3), (1,), (4, 5, 2, 3)
forecasts("wf_mean", ",".join([DATA, moments(())]), forecast_rows("historical_mean", "known", f"{LEVEL} + my"))
forecasts("wf_naive", ",".join([DATA, moments(()), NAIVE]), forecast_rows("naive", "known JOIN naive USING (series, origin_date)", "predicted"))
forecasts("wf_ewma", ",".join([DATA, moments(()), ewma()]), forecast_rows("EWMA", "known JOIN ewma USING (series, origin_date)", "predicted"))
forecasts("wf_ar1", ",".join([DATA, moments(AR_X), eliminate(AR_X, "known", "ar")]), forecast_rows("AR1", "ar", predicted(AR_X)))
forecasts("wf_har", ",".join([DATA, moments(HAR_X), eliminate(HAR_X, "known", "har")]), forecast_rows("HAR", "har", predicted(HAR_X)))
forecasts("wf_shar", ",".join([DATA, moments((2, 3, 4, 5)), eliminate(SHAR_X, "known", "shar")]), forecast_rows("SHAR", "shar", predicted(SHAR_X)))
PENALTIES = ("0.1", "1.0", "10.0", "100.0")
RIDGES = ",".join(eliminate(HAR_X, "known", f"ridge{k}", p + "e0") for k, p in enumerate(PENALTIES))
forecasts(
    "wf_ridge", ",".join([DATA, moments(HAR_X), RIDGES]),
    *[forecast_rows(f"ridge-{float(p):g}", f"ridge{k}", predicted(HAR_X)) for k, p in enumerate(PENALTIES)],
)
forecasts(
    "wf_custom_rule",
    ",".join([DATA, moments(()), """
ranked AS (SELECT series, target, row_number() OVER (PARTITION BY series ORDER BY target_date) AS k FROM data),
recent AS (
  SELECT q.series, q.origin_date, avg(e.target) AS predicted
  FROM known q JOIN ranked e ON e.series = q.series AND e.k BETWEEN q.n - 4 AND q.n GROUP BY 1, 2
)"""]),
    forecast_rows("recent_mean", "known JOIN recent USING (series, origin_date)", "predicted"),
)
forecasts(
    "wf_learning_rule",
    ",".join([DATA, moments(()), """
ranked AS (SELECT series, target, row_number() OVER (PARTITION BY series ORDER BY target_date) AS k FROM data),
learnt AS (
  SELECT q.series, q.origin_date, avg(e.target) AS predicted
  FROM known q JOIN ranked e ON e.series = q.series AND e.k BETWEEN 51 AND q.n GROUP BY 1, 2
)"""]),
    forecast_rows("learnt_mean", "known JOIN learnt USING (series, origin_date)", "predicted"),
)
sql(
    "known_totals",
    SALES + """,
days AS (SELECT DISTINCT date FROM sales),
bought AS (
  SELECT o_orderstatus AS status, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS price, max(o_orderkey) AS top, count(*) AS n
  FROM orders GROUP BY 1, 2
),
grid AS (SELECT date, status FROM days, (SELECT DISTINCT o_orderstatus AS status FROM orders)),
totals AS (
  SELECT g.date, g.status, coalesce(sum(b.n), 0) AS n_known, coalesce(sum(b.price), 0) AS price, arg_max(b.top, b.day) AS top
  FROM grid g LEFT JOIN bought b ON b.status = g.status AND b.day < g.date GROUP BY 1, 2
)""",
    f"SELECT {d('date')}, status, {ints('n_known', 'top')}, round(price, 2) AS price FROM totals",
)

START, EVALUATE, END = "DATE '1998-01-01'", "DATE '1999-01-01'", "DATE '2001-06-30'"
BETWEEN = f"q.target_date BETWEEN {START} AND {END}"
FIVE = ",".join(
    [
        DATA, moments(HAR_X, BETWEEN), NAIVE, ewma(), eliminate(AR_X, "known", "ar"), eliminate(HAR_X, "known", "har"),
        "\nlog_forecasts AS ("
        + " UNION ALL ".join(
            [
                forecast_rows("historical_mean", "known", f"{LEVEL} + my"),
                forecast_rows("naive", "known JOIN naive USING (series, origin_date)", "predicted"),
                forecast_rows("EWMA", "known JOIN ewma USING (series, origin_date)", "predicted"),
                forecast_rows("AR1", "ar", predicted(AR_X)),
                forecast_rows("HAR", "har", predicted(HAR_X)),
            ]
        )
        + ")",
    ]
)
sql("wf_models", FIVE, WF_SELECT + "log_forecasts")


def smear(source: str = "log_forecasts", name: str = "smeared") -> str:
    return f"""
{name} AS (
  SELECT q.model, q.series, q.origin_date, q.target_date, exp(any_value(q.actual)) AS actual,
         exp(any_value(q.predicted)) * avg(exp(e.actual - e.predicted)) AS predicted,
         any_value(q.n_train) AS n_train, avg(exp(e.actual - e.predicted)) AS smearing_factor
  FROM {source} q JOIN {source} e ON e.model = q.model AND e.series = q.series AND e.target_date <= q.origin_date
  GROUP BY 1, 2, 3, 4 HAVING count(*) >= 20
)"""


SCORED = f"""
scored AS (SELECT * FROM smeared WHERE target_date >= {EVALUATE}),
losses AS (
  SELECT model, origin_date, target_date, series, actual, predicted,
         greatest(actual / predicted - ln(actual / predicted) - 1, 0) AS loss FROM scored
)"""
EVALUATION = ",".join([FIVE, smear(), SCORED])
sql(
    "smeared", ",".join([FIVE, smear()]),
    f"SELECT model, series, {d('origin_date')}, {d('target_date')}, {floats('actual', 'predicted', digits=2)}, {i('n_train')}, {f('smearing_factor')} FROM smeared",
)
sql(
    "smearing_factors",
    EVALUATION + """,
factors AS (
  SELECT series, model, avg(smearing_factor) AS mean_factor, min(smearing_factor) AS min_factor, max(smearing_factor) AS max_factor
  FROM scored GROUP BY 1, 2
)""",
    f"SELECT series, model, {floats('mean_factor', 'min_factor', 'max_factor')}, {f('1 - 1 / mean_factor', 'bias_without')},"
    f" {i('mean_factor = max(mean_factor) OVER (PARTITION BY series)', 'largest_mean')} FROM factors",
)


def fits(cuts: str, used: tuple[int, ...]) -> str:
    """Sums over the outcomes before each cut date, per series."""
    sums = ["count(*) AS n", "avg(y) AS my"]
    for a in used:
        sums += [f"avg(x{a}) AS m{a}", f"sum(x{a} * y) AS p{a}y"]
    sums += [f"sum(x{a} * x{b}) AS p{a}{b}" for a, b in combinations_with_replacement(used, 2)]
    return f"""
cuts AS ({cuts}),
known AS (SELECT series, cut, {", ".join(sums)} FROM data JOIN cuts ON target_date < cut GROUP BY 1, 2)"""


def terms(model: str, source: str, columns: tuple[int, ...], names: tuple[str, ...]) -> list[str]:
    intercept = f"{LEVEL} + my" + "".join(f" - b{a} * (m{a} + {LEVEL})" for a in columns)
    rows = [("intercept", intercept), *[(name, f"b{a}") for a, name in zip(columns, names, strict=True)]]
    return [
        f"SELECT series, '{model}' AS model, cut, '{term}' AS term, {value} AS coefficient, n FROM {source}"
        for term, value in rows
    ]


BEFORE = f"SELECT {EVALUATE} AS cut"
FIT_ROWS = (
    terms("HAR", "har", HAR_X, HAR_NAMES) + terms("AR1", "ar", AR_X, HAR_NAMES[:1])
    + terms("historical_mean", "known", (), ()) + terms("ridge", "ridge", HAR_X, HAR_NAMES)
)
sql(
    "fit_known",
    ",".join(
        [
            DATA, fits(BEFORE, HAR_X), eliminate(HAR_X, "known", "har"), eliminate(AR_X, "known", "ar"),
            eliminate(HAR_X, "known", "ridge", "10e0"), f"\nfits AS ({' UNION ALL '.join(FIT_ROWS)})",
        ]
    ),
    f"SELECT series, model, {d('cut', 'before')}, term, {f('coefficient')}, {i('n', 'n_train')} FROM fits",
)
BOTH_FITS = ",".join(
    [
        DATA, fits(BEFORE, ALL_X), eliminate(HAR_X, "known", "har"), eliminate(SHAR_X, "known", "shar"),
        f"\nfits AS ({' UNION ALL '.join(terms('HAR', 'har', HAR_X, HAR_NAMES) + terms('SHAR', 'shar', SHAR_X, SHAR_NAMES))})",
    ]
)
sql(
    "coefficient_table", BOTH_FITS,
    "SELECT series, term, "
    + ", ".join(f(f"max(coefficient) FILTER (model = '{m}')", m) for m in ("HAR", "SHAR"))
    + " FROM fits GROUP BY series, term",
)
sql(
    "slope_summary", ",".join([DATA, fits(BEFORE, HAR_X), eliminate(HAR_X, "known", "har")]),
    f"""SELECT series, 'HAR' AS model, {f(f"{LEVEL} + my - b1 * (m1 + {LEVEL}) - b2 * (m2 + {LEVEL}) - b3 * (m3 + {LEVEL})", 'intercept')},
       {f('b1', 'shortest')}, {f('b2 + b3', 'longer')}, {f('b1 + b2 + b3', 'total')} FROM har""",
)
QUARTERS = (
    f"SELECT CAST(q AS DATE) + 1 AS cut FROM (SELECT unnest(generate_series({EVALUATE}, {END}, INTERVAL 3 MONTHS)) AS q)"
)
SLOPES = ",".join([DATA, fits(QUARTERS, (2, 3, 4, 5)), eliminate(SHAR_X, "known", "shar")])
sql(
    "quarterly_slopes", SLOPES,
    f"SELECT series, {d('cut - 1', 'refit_at')}, {f('b4', 'rise_mean_1')}, {f('b5', 'fall_mean_1')} FROM shar",
)


# --- penalties ------------------------------------------------------------------------------------------------


def penalties(rule: str, source: str = "known", name: str = "log_forecasts") -> str:
    rows = [forecast_rows(p, f"{name}_r{k}", predicted(HAR_X)) for k, p in enumerate(PENALTIES)]
    return ",".join(
        [
            moments(HAR_X, rule, source),
            *[eliminate(HAR_X, source, f"{name}_r{k}", p + "e0") for k, p in enumerate(PENALTIES)],
            f"\n{name} AS ({' UNION ALL '.join(rows)})",
        ]
    )


def scores(column: str, rule: str = "true", source: str = "smeared", name: str = "scores") -> str:
    ratio = "actual / predicted"
    return f"""
{name} AS (
  SELECT series, CAST(model AS DOUBLE) AS penalty, avg(greatest({ratio} - ln({ratio}) - 1, 0)) AS {column}
  FROM {source} WHERE {rule} GROUP BY 1, 2
)"""


EARLY = f"q.target_date >= {START} AND q.target_date < {EVALUATE}"
CALIBRATION = ",".join([DATA, penalties(EARLY), smear(), scores("calibration_loss")])
CHOICE = CALIBRATION + """,
choice AS (
  SELECT series, arg_min(penalty, {'s': calibration_loss, 'p': penalty}) AS penalty, min(calibration_loss) AS calibration_loss
  FROM scores GROUP BY series
)"""
sql("ridge_calibration", CALIBRATION, f"SELECT series, {floats('penalty', 'calibration_loss')} FROM scores")
sql(
    "ridge_choice", CHOICE,
    f"SELECT series, {floats('penalty', 'calibration_loss')}, {i('penalty IN (0.1, 100)', 'at_grid_edge')} FROM choice",
)
_KNOWN_CALIBRATION = CALIBRATION.replace("data AS (", "whole_data AS (", 1).replace(
    "FROM timeline WHERE pos >= 22 AND target IS NOT NULL\n)", "FROM timeline WHERE pos >= 22 AND target IS NOT NULL\n),\n"
    f"data AS (SELECT * FROM whole_data WHERE target_date < {EVALUATE})", 1)
sql(
    "ridge_uses_no_evaluation_data",
    f"""every AS (WITH {CALIBRATION.strip()} SELECT series, penalty, calibration_loss FROM scores),
known AS (WITH {_KNOWN_CALIBRATION.strip()} SELECT series, penalty, calibration_loss FROM scores)""",
    f"""SELECT {i('count(*)', 'changed_scores')} FROM every FULL JOIN known USING (series, penalty)
WHERE NOT coalesce(abs(every.calibration_loss - known.calibration_loss) <= 1e-12 * abs(known.calibration_loss), false)""",
)
sql(
    "ridge_hindsight",
    ",".join([DATA, penalties(BETWEEN), smear(), scores("evaluation_loss", f"target_date >= {EVALUATE}")]),
    f"SELECT series, {floats('penalty', 'evaluation_loss')} FROM scores",
)

sql(
    "walk_forward_violations",
    DATA + """,
broken AS (
  SELECT series, origin_date, day(origin_date) AS dom,
         CASE day(origin_date) WHEN 7 THEN origin_date WHEN 9 THEN origin_date + 5 WHEN 11 THEN NULL ELSE target_date END AS target_date
  FROM data
  UNION ALL SELECT series, origin_date, 20 AS dom, target_date FROM data WHERE day(origin_date) = 20
),
placed AS (
  SELECT *, lag(target_date) OVER (PARTITION BY series ORDER BY origin_date) AS before,
         row_number() OVER (PARTITION BY series, origin_date ORDER BY target_date) AS copy FROM broken
)""",
    f"""SELECT series, {i('count(*) FILTER (target_date IS NULL)', 'missing')},
       {i('count(*) FILTER (coalesce(origin_date >= target_date, true))', 'not_before')},
       {i('count(*) FILTER (before > target_date)', 'goes_back')}, {i('count(*) FILTER (dom = 3)', 'not_finite')},
       {i('count(*) FILTER (copy > 1)', 'repeated')} FROM placed GROUP BY series""",
)
sql(
    "forecast_violations",
    FIVE + """,
broken AS (
  SELECT model, CASE WHEN day(target_date) = 12 THEN '  ' ELSE series END AS series, target_date, day(target_date) AS dom,
         CASE day(target_date) WHEN 7 THEN target_date WHEN 9 THEN NULL ELSE origin_date END AS origin_date FROM log_forecasts
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY series, model, target_date ORDER BY origin_date) AS copy FROM broken
)""",
    f"""SELECT model, {i('count(*) FILTER (origin_date IS NULL)', 'missing')}, {i("count(*) FILTER (trim(series) = '')", 'blank')},
       {i('count(*) FILTER (dom = 3)', 'not_finite')},
       {i('count(*) FILTER (coalesce(origin_date >= target_date, true))', 'not_after')},
       {i('count(*) FILTER (copy > 1)', 'repeated')} FROM placed GROUP BY model""",
)
sql(
    "uneven_cases", FIVE,
    f"""SELECT series, {d('origin_date')}, {d('target_date')}, {i('4', 'models')}, {i('5', 'all_models')}
FROM log_forecasts WHERE model = 'EWMA' AND day(target_date) = 5""",
)

# --- comparison -----------------------------------------------------------------------------------------------

sql(
    "loss_violations", EVALUATION,
    f"""SELECT series, model, {i('count(*)', 'losses')}, {i('count(*) FILTER (day(target_date) IN (7, 9, 11))', 'invalid')}
FROM losses GROUP BY series, model""",
)
sql(
    "qlike_losses", EVALUATION,
    f"SELECT model, {d('origin_date')}, {d('target_date')}, series, {floats('actual', 'predicted', digits=2)}, {f('loss')} FROM losses",
)
sql(
    "other_losses", EVALUATION,
    f"""SELECT model, {d('origin_date')}, {d('target_date')}, series, {f('actual / 1e6', 'actual', 8)}, {f('predicted / 1e6', 'predicted')},
       {f('power(actual / 1e6 - predicted / 1e6, 2)', 'squared')}, {f('abs(actual / 1e6 - predicted / 1e6)', 'absolute')},
       {f('loss', 'qlike')} FROM losses""",
)
MODEL_NAMES = ("HAR", "historical_mean", "naive", "EWMA", "AR1")
sql(
    "loss_matrix", EVALUATION,
    f"SELECT series, {d('target_date')}, "
    + ", ".join(f(f"max(loss) FILTER (model = '{m}')", m) for m in MODEL_NAMES)
    + " FROM losses GROUP BY series, target_date",
)


def paired(candidate: str = "HAR", losses: str = "losses") -> str:
    return f"""
pairs AS (
  SELECT b.series, b.target_date, b.model AS baseline_model, b.loss AS baseline_loss, c.loss AS candidate_loss,
         b.loss - c.loss AS gain
  FROM {losses} b JOIN {losses} c ON c.series = b.series AND c.target_date = b.target_date AND c.model = '{candidate}'
  WHERE b.model <> '{candidate}'
)"""


GRID = "list_distinct(list_concat(range(0, usual + 1), [2 * usual, 4 * usual, 6 * usual]))"


def tests(lags: str) -> str:
    """Diebold-Mariano tests; ``lags`` is a list expression over n and usual."""
    return f"""
gains AS (
  SELECT *, row_number() OVER (PARTITION BY series, baseline_model ORDER BY target_date) AS k,
         count(*) OVER (PARTITION BY series, baseline_model) AS n,
         gain - avg(gain) OVER (PARTITION BY series, baseline_model) AS c FROM pairs
),
sizes AS (
  SELECT series, baseline_model, count(*) AS n, avg(gain) AS mean_gain, avg(gain * gain) AS square,
         least(CAST(floor(4 * power(count(*) / 100e0, 2e0 / 9e0)) AS BIGINT), count(*) - 2) AS usual
  FROM pairs GROUP BY 1, 2
),
chosen AS (
  SELECT * FROM (SELECT *, CAST(unnest({lags}) AS BIGINT) AS hac_lags FROM sizes) WHERE hac_lags <= n - 2
),
steps AS (SELECT DISTINCT unnest(range(0, (SELECT max(hac_lags) FROM chosen) + 1)) AS h),
gammas AS (
  SELECT a.series, a.baseline_model, h, sum(a.c * b.c) / any_value(a.n) AS gamma
  FROM gains a CROSS JOIN steps JOIN gains b
    ON b.series = a.series AND b.baseline_model = a.baseline_model AND b.k = a.k - h
  GROUP BY 1, 2, 3
),
variances AS (
  SELECT x.series, x.baseline_model, x.hac_lags, any_value(x.n) AS n_obs, any_value(x.mean_gain) AS mean_gain,
         any_value(x.square) AS square,
         greatest(sum(gamma * CASE WHEN h = 0 THEN 1 ELSE 2 * (1 - h / (x.hac_lags + 1e0)) END), 0) AS variance
  FROM chosen x JOIN gammas g ON g.series = x.series AND g.baseline_model = x.baseline_model AND g.h <= x.hac_lags
  GROUP BY 1, 2, 3
),
statistics AS (SELECT *, mean_gain / sqrt(variance / n_obs) AS statistic FROM variances),
tests AS (SELECT *, {upper_tail('statistic')} AS p_value FROM statistics)"""


PAIRED = ",".join([EVALUATION, paired()])
sql(
    "paired_gains", PAIRED,
    f"SELECT series, {d('target_date')}, baseline_model, {floats('baseline_loss', 'candidate_loss', 'gain')} FROM pairs",
)
DM_SELECT = (
    f"SELECT series, baseline_model, 'HAR' AS candidate_model, {i('hac_lags')}, {floats('statistic', 'p_value')} FROM tests"
)
sql("dm_lags", ",".join([PAIRED, tests("range(0, usual + 1)")]), DM_SELECT)
sql("dm_fixed_lags", ",".join([PAIRED, tests("[0, 3, 12]")]), DM_SELECT)
sql(
    "dm_lag_grid", ",".join([PAIRED, tests(GRID)]),
    f"SELECT series, baseline_model, {i('hac_lags')}, {f('p_value')} FROM tests",
)
_AT_LAG = ", ".join(p(f"any_value(p_value) FILTER (hac_lags = {lag})", f'"{lag}"') for lag in (0, 3, 12))
sql("dm_wide_table", ",".join([PAIRED, tests("[0, 3, 12]")]), f"SELECT series, baseline_model, {_AT_LAG} FROM tests GROUP BY 1, 2")
sql(
    "untestable_pairs",
    EVALUATION + f""",
broken AS (
  SELECT series, model, target_date AS t, CASE WHEN model = 'historical_mean' AND day(target_date) = 7 THEN 'nan' :: DOUBLE ELSE loss END AS loss
  FROM losses
  WHERE NOT (model = 'naive' AND target_date > {EVALUATE} + INTERVAL 20 DAYS) AND NOT (model = 'historical_mean' AND day(target_date) = 5)
    AND NOT (model = 'HAR' AND day(target_date) = 9)
),
own AS (SELECT series, t, loss AS theirs FROM broken WHERE model = 'HAR'),
matched AS (
  SELECT b.series, b.model, count(o.t) AS n_obs, count(*) - count(o.t) AS only_baseline,
         count(*) FILTER (o.t IS NOT NULL AND NOT (isfinite(b.loss) AND isfinite(o.theirs))) AS not_finite
  FROM broken b LEFT JOIN own o USING (series, t) WHERE model <> 'HAR' GROUP BY 1, 2
)""",
    f"""SELECT m.series, model AS baseline_model, {ints('n_obs', 'only_baseline')},
       {i('(SELECT count(*) FROM own o WHERE o.series = m.series) - n_obs', 'only_candidate')}, {i('not_finite')}, {i('n_obs < 3', 'too_few')},
       {i('len([x for x in [0, 3, 12, 40] if x > n_obs - 2])', 'lags_too_long')} FROM matched m""",
)
DEFAULT_TESTS = ",".join([PAIRED, tests("[usual]")])
WINS = """
wins AS (
  SELECT series, baseline_model, count(*) AS n_obs,
         count(*) FILTER (candidate_loss < baseline_loss AND NOT tie) AS candidate_wins, count(*) FILTER (tie) AS ties
  FROM (SELECT *, abs(candidate_loss - baseline_loss) <= 1e-5 * abs(baseline_loss) AS tie FROM pairs) GROUP BY 1, 2
)"""
MODEL_MEANS = "\nmodel_means AS (SELECT series, model, count(*) AS n_obs, avg(loss) AS mean_loss FROM losses GROUP BY 1, 2)"
sql(
    "compare_models", ",".join([DEFAULT_TESTS, MODEL_MEANS]),
    f"""SELECT m.series, m.model, {i('m.n_obs', 'n_obs')}, {f('mean_loss')}, {f('statistic', 'dm_statistic')}, {f('p_value')}
FROM model_means m LEFT JOIN tests x ON x.series = m.series AND x.baseline_model = m.model""",
)
sql(
    "win_rates", ",".join([PAIRED, WINS]),
    f"SELECT series, baseline_model, 'HAR' AS candidate_model, {ints('n_obs', 'candidate_wins', 'ties')},"
    f" {f('candidate_wins / n_obs', 'candidate_win_rate')} FROM wins",
)
RESULTS = """
results AS (
  SELECT m.series, m.model, m.n_obs, m.mean_loss, 1 - c.mean_loss / m.mean_loss AS lower_by, x.p_value,
         w.candidate_wins / w.n_obs AS candidate_win_rate
  FROM model_means m JOIN model_means c ON c.series = m.series AND c.model = 'HAR'
  LEFT JOIN tests x ON x.series = m.series AND x.baseline_model = m.model
  LEFT JOIN wins w ON w.series = m.series AND w.baseline_model = m.model
)"""
sql(
    "results_table", ",".join([DEFAULT_TESTS, MODEL_MEANS, WINS, RESULTS]),
    f"SELECT series, model, {i('n_obs')}, {floats('mean_loss', 'lower_by', 'p_value', 'candidate_win_rate')} FROM results",
)
sql(
    "candidate_verdict",
    ",".join([PAIRED, tests(GRID), MODEL_MEANS, WINS, RESULTS.replace("LEFT JOIN tests x ON x.series = m.series AND x.baseline_model = m.model", "").replace("x.p_value", "0 AS p_value"), """
worst AS (SELECT series, max(p_value) AS largest_p FROM tests GROUP BY series),
summary AS (
  SELECT series, bool_and(lower_by > 0) AS beats_all, min(lower_by) AS min_lower_by, max(lower_by) AS max_lower_by,
         max(candidate_win_rate) FILTER (model = 'naive') AS win_rate
  FROM results WHERE model <> 'HAR' GROUP BY series
)"""]),
    f"SELECT series, {i('beats_all')}, {floats('min_lower_by', 'max_lower_by', 'win_rate', 'largest_p')},"
    f" {i('largest_p < 0.01', 'below_level')} FROM summary JOIN worst USING (series)",
)
MONTHLY = """
monthly AS (
  SELECT series, strftime(target_date, '%Y-%m') AS month, model, avg(loss) AS loss FROM losses GROUP BY 1, 2, 3
)"""
sql(
    "monthly_losses", ",".join([EVALUATION, MONTHLY]),
    "SELECT series, month, " + ", ".join(f(f"max(loss) FILTER (model = '{m}')", m) for m in MODEL_NAMES)
    + " FROM monthly GROUP BY series, month",
)
_ORDER = "CASE model " + " ".join(f"WHEN '{m}' THEN {k}" for k, m in enumerate(MODEL_NAMES)) + " END"
sql(
    "month_leaders",
    ",".join([EVALUATION, MONTHLY, f"""
leaders AS (
  SELECT series, month, first(model ORDER BY loss, {_ORDER}) AS leader FROM monthly GROUP BY 1, 2
),
spans AS (SELECT series, count(*) AS months FROM leaders GROUP BY series),
grid AS (SELECT series, months, unnest({list(MODEL_NAMES)!r}) AS model FROM spans)"""]),
    f"""SELECT g.series, {i('g.months', 'months')}, g.model, {i('count(l.month)', 'months_led')}
FROM grid g LEFT JOIN leaders l ON l.series = g.series AND l.leader = g.model GROUP BY g.series, g.months, g.model""",
)
sql(
    "cumulative_advantage", PAIRED,
    f"""SELECT series, baseline_model, {d('target_date')}, {f('gain')},
       {f('sum(gain) OVER (PARTITION BY series, baseline_model ORDER BY target_date)', 'cumulative_gain')} FROM pairs""",
)
sql(
    "concentration",
    PAIRED + """,
placed AS (
  SELECT *, strftime(target_date, '%Y-%m') AS month,
         row_number() OVER (PARTITION BY series, baseline_model ORDER BY gain DESC, target_date) AS place FROM pairs
),
months AS (SELECT series, baseline_model, month, sum(gain) AS month_gain FROM placed GROUP BY 1, 2, 3),
best AS (
  SELECT series, baseline_model, first(month ORDER BY month_gain DESC, month) AS best_month FROM months GROUP BY 1, 2
),
totals AS (
  SELECT series, baseline_model, sum(gain) AS final_advantage, sum(gain) FILTER (place <= 10) / sum(gain) AS best_share
  FROM placed GROUP BY 1, 2
)""",
    f"SELECT series, baseline_model, {floats('final_advantage', 'best_share')}, best_month FROM totals JOIN best USING (series, baseline_model)",
)
sql(
    "worst_days",
    EVALUATION + """,
placed AS (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY loss DESC, target_date) AS place,
         sum(loss) OVER (PARTITION BY series) AS total, count(*) OVER (PARTITION BY series) AS n
  FROM losses WHERE model = 'HAR'
)""",
    f"""SELECT series, {i('place', 'rank')}, {d('target_date')}, {f('100 * sqrt(365.25e0 * (actual / 1e10))', 'realized_vol')},
       {f('100 * sqrt(365.25e0 * (predicted / 1e10))', 'forecast_vol')}, {f('loss')}, {f('loss / total', 'loss_share')},
       {f('5e0 / n', 'sample_share')}, {f('sqrt(actual / predicted)', 'vol_ratio')} FROM placed WHERE place <= 5""",
)
sql(
    "recent_paths",
    EVALUATION + """,
spans AS (SELECT *, max(target_date) OVER (PARTITION BY series) AS last_date FROM scored)""",
    "SELECT series, " + d("target_date") + ", "
    + f("100 * sqrt(365.25e0 * (max(actual) FILTER (model = 'HAR') / 1e10))", "realized") + ", "
    + ", ".join(f(f"100 * sqrt(365.25e0 * (max(predicted) FILTER (model = '{m}') / 1e10))", m) for m in ("HAR", "naive"))
    + " FROM spans WHERE target_date >= last_date - INTERVAL 6 MONTHS GROUP BY series, target_date",
)
SHAR_RUN = ",".join(
    [
        DATA, moments(ALL_X, BETWEEN), eliminate(HAR_X, "known", "har"), eliminate(SHAR_X, "known", "shar"),
        f"\nlog_forecasts AS ({forecast_rows('HAR', 'har', predicted(HAR_X))} UNION ALL {forecast_rows('SHAR', 'shar', predicted(SHAR_X))})",
        smear(), SCORED, paired("SHAR"),
    ]
)
sql(
    "reverse_tests", ",".join([SHAR_RUN, tests(GRID)]),
    f"SELECT series, {i('hac_lags')}, {floats('statistic', 'p_value')} FROM tests",
)
sql(
    "head_to_head",
    SHAR_RUN + """,
placed AS (
  SELECT *, strftime(target_date, '%Y-%m') AS month,
         row_number() OVER (PARTITION BY series ORDER BY gain DESC, target_date) AS place FROM pairs
),
months AS (SELECT series, month, avg(gain) AS month_gain FROM placed GROUP BY 1, 2),
won AS (SELECT series, count(*) FILTER (month_gain > 0) AS months_won, count(*) AS months FROM months GROUP BY 1),
totals AS (
  SELECT series, avg(baseline_loss) AS candidate_mean, avg(candidate_loss) AS other_mean,
         count(*) FILTER (gain > 0) / count(*) AS sessions_won,
         CASE WHEN sum(gain) > 0 THEN sum(gain) FILTER (place <= 10) / sum(gain) END AS best_share
  FROM placed GROUP BY series
)""",
    f"""SELECT series, {floats('candidate_mean', 'other_mean')}, {f('1 - other_mean / candidate_mean', 'other_lower_by')},
       {f('sessions_won')}, {ints('months_won', 'months')}, {f('best_share')} FROM totals JOIN won USING (series)""",
)
sql(
    "slope_verdict",
    ",".join(
        [
            SHAR_RUN, tests(GRID),
            fits(QUARTERS, (2, 3, 4, 5)).replace("known AS", "fit_sums AS"), eliminate(SHAR_X, "fit_sums", "refits"), """
slopes AS (SELECT series, bool_and(b4 > b5) AS up, bool_and(b5 > b4) AS down FROM refits GROUP BY series),
spread AS (SELECT series, min(p_value) AS min_p, max(p_value) AS max_p FROM tests GROUP BY series)""",
        ]
    ),
    f"""SELECT series, CASE WHEN up THEN 'rising above falling' WHEN down THEN 'falling above rising' ELSE 'changes' END AS slope_order,
       CASE WHEN max_p < 0.05 THEN 'every lag' WHEN min_p < 0.05 THEN 'some lags' ELSE 'no lag' END AS significant_at,
       {floats('min_p', 'max_p')} FROM slopes JOIN spread USING (series)""",
)
CHOSEN = ",".join(
    [
        DATA, moments(HAR_X, EARLY, "early_known"),
        *[eliminate(HAR_X, "early_known", f"early_r{k}", p + "e0") for k, p in enumerate(PENALTIES)],
        "\nearly_forecasts AS ("
        + " UNION ALL ".join(forecast_rows(p, f"early_r{k}", predicted(HAR_X)) for k, p in enumerate(PENALTIES)) + ")",
        smear("early_forecasts", "early_smeared"), scores("calibration_loss", source="early_smeared"), """
choice AS (
  SELECT series, first(penalty ORDER BY calibration_loss, penalty) AS penalty FROM scores GROUP BY series
)""",
        moments(HAR_X, BETWEEN), eliminate(HAR_X, "known", "har"),
        *[eliminate(HAR_X, "known", f"late_r{k}", p + "e0") for k, p in enumerate(PENALTIES)],
        "\nlog_forecasts AS ("
        + " UNION ALL ".join(
            [
                forecast_rows("HAR", "har", predicted(HAR_X)),
                *[
                    forecast_rows("HAR-ridge", f"late_r{k} SEMI JOIN (SELECT series FROM choice WHERE penalty = {p}) USING (series)", predicted(HAR_X))
                    for k, p in enumerate(PENALTIES)
                ],
            ]
        )
        + ")",
        smear(), SCORED, paired(), tests("[usual]"), MODEL_MEANS, WINS, RESULTS,
    ]
)
sql(
    "ridge_verdict", CHOSEN,
    f"""SELECT r.series, {f('penalty')}, {i('penalty IN (0.1, 100)', 'at_grid_edge')},
       CASE WHEN lower_by > 0 THEN 'loses to' ELSE 'beats' END AS outcome, {f('abs(lower_by)', 'difference')}, {f('p_value')}
FROM results r JOIN choice USING (series) WHERE r.model = 'HAR-ridge'""",
)

# --- description ------------------------------------------------------------------------------------------------

GAPPED = DAILY + """,
gapped AS (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY asset ORDER BY date), date) AS gap FROM daily)"""
sql(
    "data_checks", GAPPED,
    f"""SELECT asset, {i('count(*)', 'sessions')}, {d('min(date)', 'first_session')}, {d('max(date)', 'last_session')},
       {f(YEARLY, 'sessions_per_year')}, {i('count(*) - count(DISTINCT date)', 'duplicate_dates')},
       {i('max(gap)', 'longest_gap_days')}, {d('first(date ORDER BY gap DESC NULLS LAST, date)', 'longest_gap_ends')},
       {i('count(*) FILTER (observation_count = 24)', 'full_sessions')},
       {f('count(*) FILTER (observation_count = 24) / count(*)', 'full_share')}, {i('min(observation_count)', 'fewest_prices')}
FROM gapped GROUP BY asset""",
)
VOL = DAILY + f""",
years AS (SELECT asset, {YEARLY} AS per_year FROM daily GROUP BY asset),
vols AS (SELECT asset, date, log_rv, rs_pos / rv AS share, 100 * sqrt(per_year * rv) AS vol FROM daily JOIN years USING (asset))"""


def quantiles(value: str, levels: tuple[float, ...], name: str) -> str:
    return " UNION ALL ".join(
        f"SELECT asset, CAST({p} AS DOUBLE) AS level, {f(f'quantile_cont({value}, {p})', name)} FROM vols GROUP BY asset"
        for p in levels
    )


sql("vol_percentiles", VOL, quantiles("vol", (0.01, 0.5, 0.99), "vol"))
sql("rising_share", VOL, quantiles("share", (0.05, 0.5, 0.95), "rising_share"))
sql(
    "skewness", DAILY,
    f"SELECT asset, {f('skewness(rv)', 'skew_rv')}, {f('skewness(log_rv)', 'skew_log_rv')} FROM daily GROUP BY asset",
)
sql(
    "autocorrelation",
    SALES + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS k FROM sales),
lags AS (SELECT unnest(range(1, 61)) AS lag)""",
    f"""SELECT a.series, {i('lag')}, {f('corr(a.value, b.value)', 'autocorrelation')}, {i('count(*)', 'pairs')}
FROM numbered a CROSS JOIN lags JOIN numbered b ON b.series = a.series AND b.k = a.k - lag GROUP BY a.series, lag""",
)
sql(
    "histogram",
    SALES + """,
ranged AS (
  SELECT series, value, min(value) OVER (PARTITION BY series) AS low, max(value) OVER (PARTITION BY series) AS high FROM sales
),
placed AS (SELECT *, least(floor((value - low) / (high - low) * 60) + 1, 60) AS bin FROM ranged)""",
    f"""SELECT series, {i('bin')}, {f('low + (bin - 1) * (high - low) / 60', 'bin_start')}, {i('count(*)', 'rows')}
FROM placed GROUP BY series, bin, low, high""",
)
sql(
    "volatility_history", VOL,
    f"""SELECT asset, {d('date')}, {f('vol')},
       {f('''CASE WHEN row_number() OVER (PARTITION BY asset ORDER BY date) >= 5
           THEN avg(vol) OVER (PARTITION BY asset ORDER BY date ROWS 4 PRECEDING) END''', 'vol_mean')}, {f('log_rv')} FROM vols""",
)
sql(
    "stream_daily_rv",
    ",".join([TICKS, bins(60), returns(), SUMMARY, complete(12, False), f"""
closed AS (
  SELECT max({local('ts')} + INTERVAL 7 HOURS) - INTERVAL 2 HOURS AS mark FROM ticks
)"""]),
    DAILY_SELECT + "daily CROSS JOIN closed WHERE date + INTERVAL 1 DAY <= mark",
)
