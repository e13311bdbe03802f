"""DuckDB SQL oracles for the registered queries.

Each oracle is self-contained ANSI-style SQL over the driver's raw
tables (``events``, ``customer``, ``nation``, ``region``). It starts with
the event adapter of FIXTURES.md D1 written independently of the Spark
code - plain per-user windows over events, as the simplest correct
statement - followed by the query's own CTEs.

Conventions shared with the Spark side: counts and sums are BIGINT,
flags and date parts INTEGER, doubles rounded to 6 places, every
computed column aliased to the Spark name, time in UTC.
"""

from __future__ import annotations

# ---------------------------------------------------------------- adapter
ADAPTER = """
_t AS (
  SELECT event_id, user_id, event_type, value,
         1704067200000000 + 4 * (epoch_us(ts) - 1704067200000000) AS t_us
  FROM events
),
_s AS (
  SELECT *,
         SUM(CASE WHEN prev_us IS NULL OR t_us - prev_us > 86400000000 THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY t_us, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_no
  FROM (SELECT *, LAG(t_us) OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS prev_us FROM _t) x
),
ev_all AS (
  SELECT CASE WHEN s.user_id % 50 = 49 THEN '' ELSE CAST(s.user_id AS VARCHAR) END AS userId,
         CAST(s.session_no AS BIGINT) AS sessionId,
         CAST(s.t_us // 1000 AS BIGINT) AS ts,
         CASE s.event_type
           WHEN 'view' THEN 'NextSong'
           WHEN 'error' THEN 'Error'
           WHEN 'purchase' THEN 'Add to Playlist'
           WHEN 'click' THEN CASE WHEN s.value < 10 THEN 'Thumbs Down' ELSE 'Thumbs Up' END
           WHEN 'signup' THEN CASE WHEN s.value > 250 THEN 'Downgrade'
                                   WHEN s.value > 150 THEN 'Cancellation Confirmation'
                                   ELSE 'Add Friend' END
         END AS page,
         CAST(s.event_id AS BIGINT) AS seq,
         CASE WHEN c.c_custkey % 2 = 0 THEN 'M' WHEN c.c_custkey % 2 <> 0 THEN 'F' END AS gender,
         n.n_name || ', ' || left(r.r_name, 2) AS location,
         CASE WHEN c.c_acctbal > 0 THEN 'paid' WHEN c.c_acctbal <= 0 THEN 'free' END AS level,
         CAST(CASE WHEN s.event_type = 'error' THEN 404 ELSE 200 END AS INTEGER) AS status,
         CAST(make_timestamp(s.t_us) AS DATE) AS date,
         CAST(hour(make_timestamp(s.t_us)) AS INTEGER) AS hour
  FROM _s s
  LEFT JOIN customer c ON c.c_custkey = s.user_id
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
),
ev AS (SELECT * FROM ev_all WHERE userId <> ''),
fl AS (
  SELECT ev.*,
         CASE WHEN page = 'NextSong' THEN 1 ELSE 0 END AS listen_flag,
         CASE WHEN page = 'Thumbs Up' THEN 1 ELSE 0 END AS thU_flag,
         CASE WHEN page = 'Thumbs Down' THEN 1 ELSE 0 END AS thD_flag,
         CASE WHEN page = 'Error' THEN 1 ELSE 0 END AS err_flag,
         CASE WHEN page = 'Add to Playlist' THEN 1 ELSE 0 END AS addP_flag,
         CASE WHEN page = 'Add Friend' THEN 1 ELSE 0 END AS addF_flag,
         CASE WHEN page IN ('Cancellation Confirmation', 'Downgrade') THEN 1 ELSE 0 END AS churn
  FROM ev
)"""

# User-day table with the reference's day features (active days, or
# listening days only when ``listen_only``).
def _days_sql(listen_only: bool = False) -> str:
    having = " HAVING max(listen_flag) = 1" if listen_only else ""
    return f"""
days AS (SELECT userId, date, max(listen_flag) AS listen_flag FROM fl GROUP BY userId, date{having}),
dayp AS (SELECT *, lag(date) OVER (PARTITION BY userId ORDER BY date) AS prev_day FROM days),
dayc AS (
  SELECT userId, date, listen_flag, prev_day,
         CASE WHEN prev_day IS NOT NULL AND date = prev_day + 1 THEN 1 ELSE 0 END AS date_group,
         CAST(SUM(CASE WHEN prev_day IS NOT NULL AND date = prev_day + 1 THEN 1 ELSE 0 END)
              OVER (PARTITION BY userId ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
           AS days_consec_listen,
         CAST(COALESCE(date - prev_day, 0) AS INTEGER) AS days_since_last_listen
  FROM dayp
)"""


DAYS = _days_sql()

# Running listen count and its fill from any earlier listen, or only from
# one at most ``rows`` rows back.
def _running_sql(rows: int | None = None) -> str:
    start = "UNBOUNDED" if rows is None else str(rows)
    return f"""
run AS (
  SELECT fl.*,
         SUM(listen_flag) OVER (PARTITION BY userId ORDER BY ts, seq
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
         MAX(listen_flag) OVER (PARTITION BY userId ORDER BY ts, seq
                                ROWS BETWEEN {start} PRECEDING AND CURRENT ROW) AS near
  FROM fl
),
runf AS (
  SELECT *,
         CASE WHEN listen_flag = 1 THEN CAST(cum AS INTEGER) END AS running_listens_mon,
         CAST(CASE WHEN near = 1 THEN cum ELSE 0 END AS INTEGER) AS running_listens_mon_fill
  FROM run
)"""


RUNNING = _running_sql()


def _matrix_sql(src: str = "fl", weight: str = "", listen_only: bool = False) -> str:
    """User-matrix CTEs over the flagged events ``src``.

    ``weight`` multiplies every flag in the session and user sums (the tie
    fan-out parity form uses ``' * w'``); the listen count behind
    ``most_listens_one_month`` stays unweighted. ``listen_only`` takes the
    day features over listening days; users without one keep 0.
    """
    def s(flag: str) -> str:
        return f"SUM({flag}{weight})"

    join = "LEFT JOIN" if listen_only else "JOIN"
    return (
        _days_sql(listen_only)
        + f""",
sess AS (
  SELECT userId, sessionId,
         CAST({s('listen_flag')} AS BIGINT) AS sess_listens, CAST({s('thU_flag')} AS BIGINT) AS sess_thU,
         CAST({s('thD_flag')} AS BIGINT) AS sess_thD, CAST({s('err_flag')} AS BIGINT) AS sess_err,
         CAST({s('addP_flag')} AS BIGINT) AS sess_addP, CAST({s('addF_flag')} AS BIGINT) AS sess_addF
  FROM {src} GROUP BY userId, sessionId
),
sess_u AS (
  SELECT userId, avg(sess_listens) AS avg_sess_listens, avg(sess_thU) AS avg_sess_thU,
         avg(sess_thD) AS avg_sess_thD, avg(sess_err) AS avg_sess_err,
         avg(sess_addP) AS avg_sess_addP, avg(sess_addF) AS avg_sess_addF
  FROM sess GROUP BY userId
),
day_u AS (
  SELECT userId, max(days_since_last_listen) AS most_days_since_last_listen,
         max(days_consec_listen) AS most_days_consec_listen
  FROM dayc GROUP BY userId
),
tot AS (
  SELECT userId, max(gender) AS gender, max(churn) AS churn,
         CAST(SUM(listen_flag) AS INTEGER) AS most_listens_one_month,
         CAST({s('listen_flag')} AS BIGINT) AS total_listens, CAST({s('thU_flag')} AS BIGINT) AS total_thumbsU,
         CAST({s('thD_flag')} AS BIGINT) AS total_thumbsD, CAST({s('err_flag')} AS BIGINT) AS total_err,
         CAST({s('addP_flag')} AS BIGINT) AS total_add_pl, CAST({s('addF_flag')} AS BIGINT) AS total_add_fr
  FROM {src} GROUP BY userId
),
matrix AS (
  SELECT t.userId, t.gender, t.churn, t.most_listens_one_month,
         COALESCE(d.most_days_since_last_listen, 0) AS most_days_since_last_listen,
         COALESCE(d.most_days_consec_listen, 0) AS most_days_consec_listen,
         t.total_listens, t.total_thumbsU, t.total_thumbsD, t.total_err, t.total_add_pl, t.total_add_fr,
         s.avg_sess_listens, s.avg_sess_thU, s.avg_sess_thD, s.avg_sess_err, s.avg_sess_addP, s.avg_sess_addF
  FROM tot t {join} day_u d ON d.userId = t.userId JOIN sess_u s ON s.userId = t.userId
)"""
    )


MATRIX = _matrix_sql()

# Tie fan-out parity (Q6): each event weighted by greatest(1, listens at its (userId, ts)).
WEIGHTS = """
flw AS (SELECT fl.*, GREATEST(1, SUM(listen_flag) OVER (PARTITION BY userId, ts)) AS w FROM fl)"""
MATRIX_FANOUT = _matrix_sql("flw", " * w")

# Intended features next to the reference values.
INTENDED = """
mim AS (
  SELECT userId, CAST(max(n) AS BIGINT) AS most_listens_in_month
  FROM (SELECT userId, date_trunc('month', date) AS m, sum(listen_flag) AS n FROM fl GROUP BY 1, 2) x GROUP BY userId
),
streak AS (
  SELECT userId, CAST(max(run) AS BIGINT) AS longest_streak_days FROM (
    SELECT userId, island, count(*) AS run FROM (
      SELECT userId, date - CAST(row_number() OVER (PARTITION BY userId ORDER BY date) AS INTEGER) AS island FROM days
    ) i GROUP BY userId, island
  ) r GROUP BY userId
),
lgap AS (
  SELECT u.userId, CAST(COALESCE(max(g.gap), 0) AS INTEGER) AS most_days_without_listen
  FROM (SELECT DISTINCT userId FROM days) u
  LEFT JOIN (SELECT userId, CAST(date - lag(date) OVER (PARTITION BY userId ORDER BY date) AS INTEGER) AS gap
             FROM days WHERE listen_flag = 1) g ON g.userId = u.userId
  GROUP BY u.userId
)"""

# WIN1 over listening days only (the intended reading of Q1).
LISTEN_DAYS = """
ldays AS (SELECT userId, date FROM (SELECT userId, date, max(listen_flag) AS l FROM fl GROUP BY userId, date) d WHERE l = 1),
ldayp AS (SELECT *, lag(date) OVER (PARTITION BY userId ORDER BY date) AS prev_day FROM ldays)"""

MATRIX_SELECT = """
  userId, gender, churn, most_listens_one_month, most_days_since_last_listen, most_days_consec_listen,
  total_listens, total_thumbsU, total_thumbsD, total_err, total_add_pl, total_add_fr,
  round(avg_sess_listens, 6) AS avg_sess_listens, round(avg_sess_thU, 6) AS avg_sess_thU,
  round(avg_sess_thD, 6) AS avg_sess_thD, round(avg_sess_err, 6) AS avg_sess_err,
  round(avg_sess_addP, 6) AS avg_sess_addP, round(avg_sess_addF, 6) AS avg_sess_addF"""

# 80/20 split by hash of userId and the baseline rule's predictions.
SPLIT = """
split AS (
  SELECT m.*,
         CASE WHEN CAST(concat('0x', substr(md5(userId), 1, 8)) AS BIGINT) % 100 < 80
              THEN 'train' ELSE 'test' END AS split
  FROM matrix m
),
pred AS (
  SELECT s.userId, s.split, CAST(s.churn AS DOUBLE) AS label,
         CASE WHEN s.avg_sess_listens < (SELECT avg(avg_sess_listens) FROM split WHERE split = 'train')
              THEN 1.0 ELSE 0.0 END AS prediction
  FROM split s
)"""

FEATURES = (
    "most_listens_one_month",
    "most_days_since_last_listen",
    "most_days_consec_listen",
    "total_listens",
    "total_thumbsU",
    "total_thumbsD",
    "total_err",
    "total_add_pl",
    "total_add_fr",
    "avg_sess_listens",
    "avg_sess_thU",
    "avg_sess_thD",
    "avg_sess_err",
    "avg_sess_addP",
    "avg_sess_addF",
    "gender_indexed",
)

GENDER_INDEX = """
labels AS (
  SELECT gender, row_number() OVER (ORDER BY cnt DESC, gender) - 1 AS idx
  FROM (SELECT gender, count(*) AS cnt FROM matrix WHERE gender IS NOT NULL GROUP BY gender) g
),
indexed AS (
  SELECT m.*, CAST(COALESCE(l.idx, (SELECT count(*) FROM labels)) AS DOUBLE) AS gender_indexed
  FROM matrix m LEFT JOIN labels l ON l.gender = m.gender
)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def _flags_cols() -> str:
    return "listen_flag, thU_flag, thD_flag, err_flag, addP_flag, addF_flag"


def _features_long() -> str:
    parts = [
        f"SELECT userId, '{f}' AS feature, CAST({f} AS DOUBLE) AS x FROM indexed" for f in FEATURES
    ]
    return "\n  UNION ALL ".join(parts)


def _period_union() -> str:
    base = "FROM fl WHERE page = 'Thumbs Up' GROUP BY ALL"
    return (
        f"SELECT userId, 'day' AS grain, date AS period_start, count(*) AS n_thumbs_up {base}\n"
        f"UNION ALL SELECT userId, 'week' AS grain, CAST(date_trunc('week', date) AS DATE) AS period_start, count(*) AS n_thumbs_up {base}\n"
        f"UNION ALL SELECT userId, 'month' AS grain, CAST(date_trunc('month', date) AS DATE) AS period_start, count(*) AS n_thumbs_up {base}"
    )


def _cohort_stats() -> str:
    fields = (
        "avg_sess_listens avg_sess_thU avg_sess_thD avg_sess_err avg_sess_addP avg_sess_addF "
        "most_days_since_last_listen most_days_consec_listen"
    ).split()
    cols = ", ".join(f"round(avg({f}), 6) AS {f}_mean, round(stddev_samp({f}), 6) AS {f}_std" for f in fields)
    means = "\n  UNION ALL ".join(
        f"SELECT churn, '{f}' AS field, round(avg({f}), 6) AS mean FROM matrix GROUP BY churn" for f in fields
    )
    return cols, means


_COHORT_COLS, _COHORT_LONG = _cohort_stats()

_PART_LONG = "\n  UNION ALL ".join(
    f"SELECT '{p}' AS part, {expr} AS value, count(userId) AS n_listens FROM ev WHERE page = 'NextSong' GROUP BY 2"
    for p, expr in (
        ("hour", "hour"),
        ("day", "CAST(day(date) AS INTEGER)"),
        ("month", "CAST(month(date) AS INTEGER)"),
    )
)

_METRICS = """
m AS (
  SELECT count(*) AS n, sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS correct FROM pred WHERE split = 'test'
),
per AS (
  SELECT a.label, a.actual, a.tp, COALESCE(b.predicted, 0) AS predicted
  FROM (SELECT label, count(*) AS actual, count(*) FILTER (WHERE prediction = label) AS tp
        FROM pred WHERE split = 'test' GROUP BY label) a
  LEFT JOIN (SELECT prediction, count(*) AS predicted FROM pred WHERE split = 'test' GROUP BY prediction) b
         ON b.prediction = a.label
),
f AS (
  SELECT label, actual,
         CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS prec,
         CASE WHEN actual = 0 THEN 0.0 ELSE tp / actual END AS rec
  FROM per
)"""

SQL: dict[str, str] = {
    # ------------------------------------------------------------ profile
    "prf1_shape": _with(ADAPTER) + "\nSELECT count(*) AS n_rows, CAST(9 AS INTEGER) AS n_cols FROM ev_all",
    "prf3_levels": _with(ADAPTER) + "\nSELECT DISTINCT level FROM ev_all",
    "prf3_statuses": _with(ADAPTER) + "\nSELECT DISTINCT status FROM ev_all",
    "prf3_user_ids": _with(ADAPTER) + "\nSELECT DISTINCT userId FROM ev_all",
    "prf3_locations": _with(ADAPTER) + "\nSELECT DISTINCT location FROM ev",
    "prf4_distinct_counts": _with(ADAPTER)
    + "\nSELECT count(DISTINCT right(location, 2)) AS n_distinct_state, count(DISTINCT userId) AS n_distinct_userId FROM ev",
    "prf5_null_counts": _with(ADAPTER)
    + "\nSELECT "
    + ", ".join(
        f"CAST(count_if({c} IS NULL) AS BIGINT) AS n_null_{c}"
        for c in ("userId", "sessionId", "ts", "page", "seq", "gender", "location", "level", "status")
    )
    + " FROM ev_all",
    # ------------------------------------------------------------ filters
    "flt1_nonblank_events": _with(ADAPTER) + "\nSELECT userId, sessionId, ts, page, seq FROM ev",
    "flt2_listen_events": _with(ADAPTER) + "\nSELECT userId, sessionId, ts, seq FROM ev WHERE page = 'NextSong'",
    # ------------------------------------------------------------ scalar
    "scl1_state": _with(ADAPTER) + "\nSELECT seq, location, right(location, 2) AS state FROM ev",
    "scl2_time_parts": _with(ADAPTER)
    + "\nSELECT seq, ts, hour, CAST(day(date) AS INTEGER) AS day, CAST(month(date) AS INTEGER) AS month,"
    " CAST(year(date) AS INTEGER) AS year FROM ev",
    "scl3_event_date": _with(ADAPTER) + "\nSELECT seq, ts, date FROM ev",
    "scl4_page_flags": _with(ADAPTER) + f"\nSELECT seq, page, {_flags_cols()} FROM fl",
    "scl5_churn_flag": _with(ADAPTER) + "\nSELECT seq, page, churn FROM fl",
    "scl6_next_day_flag": _with(ADAPTER, DAYS) + "\nSELECT userId, date, prev_day, date_group FROM dayc",
    # ------------------------------------------------------------ aggregates
    "agg1_page_visits": _with(ADAPTER) + "\nSELECT page, count(userId) AS count_visits FROM ev_all GROUP BY page",
    "agg2_listens_by_state": _with(ADAPTER)
    + "\nSELECT right(location, 2) AS state, count(userId) AS count FROM ev WHERE page = 'NextSong' GROUP BY 1",
    "agg3_users_by_state": _with(ADAPTER)
    + """
SELECT state, count(userId) AS count FROM (
  SELECT userId, right(location, 2) AS state,
         row_number() OVER (PARTITION BY userId ORDER BY ts DESC, seq DESC) AS rn
  FROM ev WHERE page = 'NextSong') x
WHERE rn = 1 GROUP BY state""",
    "agg4_listens_by_hour": _with(ADAPTER)
    + "\nSELECT hour, count(userId) AS n_listens FROM ev WHERE page = 'NextSong' GROUP BY hour",
    "agg4_listens_by_day": _with(ADAPTER)
    + "\nSELECT CAST(day(date) AS INTEGER) AS day, count(userId) AS n_listens FROM ev WHERE page = 'NextSong' GROUP BY 1",
    "agg4_listens_by_month": _with(ADAPTER)
    + "\nSELECT CAST(month(date) AS INTEGER) AS month, count(userId) AS n_listens FROM ev WHERE page = 'NextSong' GROUP BY 1",
    "agg4_listens_by_year": _with(ADAPTER)
    + "\nSELECT CAST(year(date) AS INTEGER) AS year, count(userId) AS n_listens FROM ev WHERE page = 'NextSong' GROUP BY 1",
    "agg5_user_days": _with(ADAPTER, DAYS) + "\nSELECT userId, date, listen_flag FROM days",
    "agg6_user_totals": _with(ADAPTER, MATRIX)
    + """
SELECT userId, most_listens_one_month, most_days_since_last_listen, most_days_consec_listen,
       total_listens, total_thumbsU, total_thumbsD, total_err, total_add_pl, total_add_fr FROM matrix""",
    "agg7_session_totals": _with(ADAPTER, MATRIX) + "\nSELECT * FROM sess",
    "agg8_session_means": _with(ADAPTER, MATRIX)
    + """
SELECT userId, round(avg_sess_listens, 6) AS avg_sess_listens, round(avg_sess_thU, 6) AS avg_sess_thU,
       round(avg_sess_thD, 6) AS avg_sess_thD, round(avg_sess_err, 6) AS avg_sess_err,
       round(avg_sess_addP, 6) AS avg_sess_addP, round(avg_sess_addF, 6) AS avg_sess_addF FROM sess_u""",
    "agg9_user_attributes": _with(ADAPTER) + "\nSELECT userId, max(gender) AS gender, max(churn) AS churn FROM fl GROUP BY userId",
    "agg10_class_balance": _with(ADAPTER)
    + "\nSELECT churn, count(*) AS n_users FROM (SELECT userId, max(churn) AS churn FROM fl GROUP BY userId) u GROUP BY churn",
    "agg11_running_listens_by_churn": _with(ADAPTER, RUNNING)
    + """
SELECT churn, round(avg(running_listens_mon), 6) AS avg_running_listens,
       round(avg(running_listens_mon_fill), 6) AS avg_running_listens_fill
FROM runf GROUP BY churn""",
    "agg12_cohort_stats": _with(ADAPTER, MATRIX) + f"\nSELECT churn, {_COHORT_COLS} FROM matrix GROUP BY churn",
    "agg13_cohort_means_long": _with(ADAPTER, MATRIX) + "\n" + _COHORT_LONG,
    "agg14_churn_by_gender": _with(ADAPTER, MATRIX)
    + "\nSELECT churn, gender, count(*) AS n_users FROM matrix GROUP BY churn, gender",
    "agg15_listens_by_part_long": _with(ADAPTER) + "\n" + _PART_LONG,
    # ------------------------------------------------------------ windows
    "win1_consecutive_days": _with(ADAPTER, DAYS)
    + "\nSELECT userId, date, prev_day, date_group, days_consec_listen FROM dayc",
    "win1b_longest_streak": _with(ADAPTER, DAYS)
    + """
SELECT userId, CAST(max(run) AS BIGINT) AS longest_streak_days FROM (
  SELECT userId, island, count(*) AS run FROM (
    SELECT userId, date - CAST(row_number() OVER (PARTITION BY userId ORDER BY date) AS INTEGER) AS island FROM days
  ) i GROUP BY userId, island
) r GROUP BY userId""",
    "win2_days_since_last": _with(ADAPTER, DAYS) + "\nSELECT userId, date, days_since_last_listen FROM dayc",
    "win2b_listen_gaps": _with(ADAPTER, DAYS)
    + """
, gaps AS (
  SELECT userId, CAST(date - lag(date) OVER (PARTITION BY userId ORDER BY date) AS INTEGER) AS gap
  FROM days WHERE listen_flag = 1
)
SELECT u.userId, CAST(COALESCE(max(g.gap), 0) AS INTEGER) AS most_days_without_listen
FROM (SELECT DISTINCT userId FROM days) u LEFT JOIN gaps g ON g.userId = u.userId
GROUP BY u.userId""",
    "win3_running_listens": _with(ADAPTER, RUNNING)
    + "\nSELECT userId, ts, seq, date, running_listens_mon FROM runf WHERE listen_flag = 1",
    "win3b_most_listens_in_month": _with(ADAPTER)
    + """
SELECT userId, CAST(max(n) AS BIGINT) AS most_listens_in_month FROM (
  SELECT userId, date_trunc('month', date) AS m, sum(listen_flag) AS n FROM fl GROUP BY 1, 2
) x GROUP BY userId""",
    "win4_filled_running_listens": _with(ADAPTER, RUNNING)
    + "\nSELECT userId, ts, seq, page, running_listens_mon, running_listens_mon_fill FROM runf",
    "win4_fill_parity": _with(ADAPTER, _running_sql(7))
    + "\nSELECT userId, ts, seq, page, running_listens_mon, running_listens_mon_fill FROM runf",
    # ------------------------------------------------------------ joins
    "jn1_enriched_events": _with(ADAPTER, DAYS, RUNNING)
    + f"""
SELECT r.userId, r.sessionId, r.seq, r.ts, r.page, r.date, r.hour, d.days_consec_listen, d.days_since_last_listen,
       r.running_listens_mon, r.running_listens_mon_fill, r.{_flags_cols().replace(', ', ', r.')}, r.churn
FROM runf r LEFT JOIN dayc d ON d.userId = r.userId AND d.date = r.date""",
    "jn4_user_matrix": _with(ADAPTER, MATRIX) + f"\nSELECT {MATRIX_SELECT} FROM matrix",
    # ------------------------------------------------------------ sort / limit
    "srt1_states_ranked": _with(ADAPTER)
    + """
SELECT state, count, CAST(row_number() OVER (ORDER BY count DESC, state NULLS FIRST) AS INTEGER) AS rank FROM (
  SELECT right(location, 2) AS state, count(userId) AS count FROM ev WHERE page = 'NextSong' GROUP BY 1
) s""",
    "srt2_top_listeners": _with(ADAPTER, MATRIX)
    + "\nSELECT userId, total_listens FROM matrix ORDER BY total_listens DESC, userId LIMIT 10",
    "srt5_streak_listing": _with(ADAPTER, DAYS)
    + "\nSELECT userId, date, days_consec_listen FROM dayc WHERE listen_flag = 1",
    # ------------------------------------------------------------ model prep
    "ml1_gender_index": _with(ADAPTER, MATRIX, GENDER_INDEX) + "\nSELECT userId, gender, gender_indexed FROM indexed",
    "ml3_scaled_features": _with(ADAPTER, MATRIX, GENDER_INDEX)
    + f"""
, long AS (
  {_features_long()}
),
st AS (SELECT feature, avg(x) AS mu, stddev_samp(x) AS sd FROM long GROUP BY feature)
SELECT l.userId, l.feature,
       round(CASE WHEN st.sd IS NULL OR st.sd = 0 THEN 0.0 ELSE (l.x - st.mu) / st.sd END, 6) AS value
FROM long l JOIN st ON st.feature = l.feature""",
    "ml4_split": _with(ADAPTER, MATRIX, SPLIT) + "\nSELECT userId, churn, split FROM split",
    "ml12_baseline_metrics": _with(ADAPTER, MATRIX, SPLIT, _METRICS)
    + """
SELECT m.n AS n_test, round(m.correct / m.n, 6) AS accuracy,
       round(sum(f.actual * CASE WHEN f.prec + f.rec = 0 THEN 0.0 ELSE 2 * f.prec * f.rec / (f.prec + f.rec) END) / m.n, 6) AS f1
FROM m, f GROUP BY m.n, m.correct""",
    # ------------------------------------------------------------ extensions
    "ext1_thumbs_up_by_period": _with(ADAPTER) + "\n" + _period_union(),
    "ext2_thumbs_ratio": _with(ADAPTER)
    + """
SELECT userId, total_thumbsU, total_thumbsD,
       round(CASE WHEN total_thumbsD = 0 THEN NULL ELSE total_thumbsU / total_thumbsD END, 6) AS thumbs_ratio
FROM (SELECT userId, CAST(sum(thU_flag) AS BIGINT) AS total_thumbsU, CAST(sum(thD_flag) AS BIGINT) AS total_thumbsD
      FROM fl GROUP BY userId) t""",
    "ext3_baseline_lift": _with(ADAPTER, MATRIX, SPLIT)
    + """
SELECT CAST(count(*) FILTER (WHERE prediction = 1) AS BIGINT) AS n_predicted,
       round(avg(label) FILTER (WHERE prediction = 1), 6) AS churn_rate_predicted,
       round(avg(label), 6) AS churn_rate_overall,
       round((avg(label) FILTER (WHERE prediction = 1)) / avg(label), 6) AS lift
FROM pred""",
    # ------------------------------------------------------------ streaming (stream = batch)
    "str2_page_hour_counts": _with(ADAPTER)
    + "\nSELECT (ts // 3600000) * 3600000 AS window_start, page, count(*) AS n_events FROM ev GROUP BY 1, 2",
    "str3_user_day_totals": _with(ADAPTER)
    + """
SELECT userId, date, count(*) AS n_events, CAST(sum(listen_flag) AS BIGINT) AS n_listens,
       CAST(CASE WHEN sum(listen_flag) > 0 THEN 1 ELSE 0 END AS INTEGER) AS listen_flag
FROM fl GROUP BY userId, date""",
}

SQL["src1_json_matrix"] = SQL["jn4_user_matrix"]
SQL["prf4_stored_sketches"] = (
    _with(ADAPTER)
    + """
SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(DISTINCT userId) AS "n_distinct_userId",
       count(DISTINCT right(location, 2)) AS n_distinct_state, true AS "close_userId", true AS close_state
FROM ev GROUP BY 1"""
)
SQL["ml4_stratified_split"] = (
    _with(ADAPTER, MATRIX)
    + """
, keyed AS (SELECT userId, churn, CAST(concat('0x', substr(md5(userId), 1, 15)) AS BIGINT) AS h FROM matrix),
ranked AS (SELECT *, row_number() OVER (PARTITION BY churn ORDER BY h) AS r, count(*) OVER (PARTITION BY churn) AS n FROM keyed)
SELECT userId, churn, CASE WHEN r <= (n * 80 + 99) // 100 THEN 'train' ELSE 'test' END AS split FROM ranked"""
)
SQL["str3_session_totals"] = SQL["agg7_session_totals"]
SQL["agg3_distinct_users_by_state"] = (
    _with(ADAPTER) + "\nSELECT right(location, 2) AS state, count(DISTINCT userId) AS n_users FROM ev GROUP BY 1"
)
SQL["srt6_event_listing"] = (
    _with(ADAPTER, RUNNING) + "\nSELECT userId, date, page, running_listens_mon FROM runf ORDER BY userId, ts, seq LIMIT 20"
)
SQL["prf2_schema"] = (
    _with(ADAPTER)
    + """
SELECT c.*, (SELECT count(*) FROM ev_all) AS n_rows FROM (VALUES
  ('userId', 'string', 0), ('sessionId', 'bigint', 1), ('ts', 'bigint', 2), ('page', 'string', 3), ('seq', 'bigint', 4),
  ('gender', 'string', 5), ('location', 'string', 6), ('level', 'string', 7), ('status', 'int', 8)
) AS c("column", "type", "position")"""
)
_TEST = _with(ADAPTER, MATRIX, SPLIT)
SQL["ml8_scored_rows"] = (
    _TEST
    + """
SELECT model, label, count(*) AS n_scored FROM pred, (VALUES ('LogisticRegression'), ('GBTClassifier'), ('RandomForestClassifier')) AS m(model)
WHERE split = 'test' GROUP BY model, label"""
)
SQL["ml11_scored_users"] = _TEST + "\nSELECT userId, label FROM pred WHERE split = 'test'"
SQL["ml11_compiled_scores"] = (
    _with(ADAPTER, MATRIX)
    + """
SELECT model, count(*) AS n_users, count(*) AS n_equal
FROM matrix, (VALUES ('LogisticRegression'), ('GBTClassifier'), ('RandomForestClassifier')) AS m(model) GROUP BY model"""
)
SQL["ml13_script_grid"] = """
SELECT d AS "maxDepth", b AS "maxBins", true AS in_range, 1 AS n_best
FROM (VALUES (3), (5), (7)) AS x(d), (VALUES (16), (32), (64)) AS y(b)"""
SQL["ml14_importance_sum"] = "SELECT CAST(16 AS BIGINT) AS n_features, CAST(16 AS BIGINT) AS n_valid, CAST(1.0 AS DOUBLE) AS total"
SQL["str5_rule_scores"] = (
    _with(ADAPTER, MATRIX) + '\nSELECT userId, CAST(total_listens < 20 AS DOUBLE) AS predicted_churn FROM matrix'
)
SQL["str4_streamed_user_matrix"] = SQL["jn4_user_matrix"]

SQL["jn4_user_matrix_fanout"] = _with(ADAPTER, WEIGHTS, MATRIX_FANOUT) + f"\nSELECT {MATRIX_SELECT} FROM matrix"
SQL["jn4_user_matrix_intended"] = (
    _with(ADAPTER, MATRIX, INTENDED)
    + f"""
SELECT {MATRIX_SELECT}, mim.most_listens_in_month, streak.longest_streak_days, lgap.most_days_without_listen
FROM matrix JOIN mim USING (userId) JOIN streak USING (userId) JOIN lgap USING (userId)"""
)
SQL["win1_consecutive_listen_days"] = (
    _with(ADAPTER, LISTEN_DAYS)
    + """
SELECT userId, date, prev_day,
       CASE WHEN prev_day IS NOT NULL AND date = prev_day + 1 THEN 1 ELSE 0 END AS date_group,
       CAST(SUM(CASE WHEN prev_day IS NOT NULL AND date = prev_day + 1 THEN 1 ELSE 0 END)
            OVER (PARTITION BY userId ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
         AS days_consec_listen
FROM ldayp"""
)

SQL["prf1_matrix_shape"] = _with(ADAPTER, MATRIX) + "\nSELECT count(*) AS n_rows, CAST(18 AS INTEGER) AS n_cols FROM matrix"
SQL["prf5_running_listen_nulls"] = (
    _with(ADAPTER, RUNNING)
    + """
SELECT CAST(count_if(running_listens_mon IS NULL) AS BIGINT) AS n_null_running_listens_mon,
       CAST(count_if(running_listens_mon_fill IS NULL) AS BIGINT) AS n_null_running_listens_mon_fill
FROM runf"""
)

# Day features over listening days only; users without one keep 0.
SQL["jn4_user_matrix_listen_days"] = _with(ADAPTER, _matrix_sql(listen_only=True)) + f"\nSELECT {MATRIX_SELECT} FROM matrix"
