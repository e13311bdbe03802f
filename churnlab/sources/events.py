"""Event sources.

SRC1  ``read_json_events``  - the JSON-lines event log, fixed schema
SRC2  ``choose_event_path`` - small or full log by a job argument
SRC3  ``load_events``       - the driver's parquet tables mapped onto the
                              canonical event frame (see FIXTURES.md D1)

All three return lazy DataFrames; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlab.schema import RAW_EVENT_SCHEMA

CORRUPT_COLUMN = "_corrupt_record"


# --------------------------------------------------------------------- SRC1
def read_json_events(
    spark: SparkSession,
    path: str,
    infer_schema: bool = False,
    keep_corrupt: bool = False,
) -> DataFrame:
    """Read a JSON-lines event log.

    By default the schema is fixed, which saves the full extra pass that
    inference makes over the input. ``keep_corrupt`` adds a
    ``_corrupt_record`` column holding lines that did not parse.
    """
    reader = spark.read
    if not infer_schema:
        schema = RAW_EVENT_SCHEMA
        if keep_corrupt:
            schema = T.StructType([*schema.fields, T.StructField(CORRUPT_COLUMN, T.StringType())])
        reader = reader.schema(schema)
    if keep_corrupt:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
    return reader.json(path)


def to_events(raw: DataFrame) -> DataFrame:
    """Map a raw JSON log onto the canonical event frame.

    ``itemInSession`` becomes the tie-break ``seq``; together with ``ts``
    it orders events of one user deterministically.
    """
    cols = set(raw.columns)

    def pick(name: str, dtype: str) -> Column:
        return (F.col(name) if name in cols else F.lit(None)).cast(dtype).alias(name)

    seq = (F.col("itemInSession") if "itemInSession" in cols else F.lit(None)).cast("long").alias("seq")
    return raw.select(
        pick("userId", "string"),
        pick("sessionId", "long"),
        pick("ts", "long"),
        pick("page", "string"),
        seq,
        pick("gender", "string"),
        pick("location", "string"),
        pick("level", "string"),
        pick("status", "int"),
    )


# --------------------------------------------------------------------- SRC2
def choose_event_path(size: str | None, mini_path: str, full_path: str) -> str:
    """Pick the small log for ``'mini'``, the full log for any other value.

    A missing argument is an error, as in a job started without one.
    """
    if size is None:
        raise ValueError("an event-log size argument is required: 'mini' or another value")
    return mini_path if size == "mini" else full_path


# --------------------------------------------------------------------- SRC3
# Fixed values of the adapter (FIXTURES.md D1): the driver's January
# 2024 events are stretched four times around this origin so that the
# log spans several calendar months and has day gaps.
ORIGIN_US = 1_704_067_200_000_000  # 2024-01-01 00:00:00 UTC, microseconds
STRETCH = 4
SESSION_GAP_US = 86_400_000_000  # a gap over 24 h starts a new session
DAY_US = 86_400_000_000
BLANK_USER_MODULUS = 50  # user_id % 50 == 49 -> blank userId
BLANK_USER_REMAINDER = 49


def _epoch_micros(ts: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.TimestampNTZType):
        # Wall clock taken as UTC, independent of the session time zone.
        return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(ts)
    return ts.cast("long")  # already micros


def _page_of(event_type: Column, value: Column) -> Column:
    # one flat CASE of literals: a filter on a page becomes one on the raw column
    is_click, is_signup = event_type == "click", event_type == "signup"
    return (
        F.when(event_type == "view", F.lit("NextSong"))
        .when(event_type == "error", F.lit("Error"))
        .when(event_type == "purchase", F.lit("Add to Playlist"))
        .when(is_click & (value < 10), F.lit("Thumbs Down"))
        .when(is_click, F.lit("Thumbs Up"))
        .when(is_signup & (value > 250), F.lit("Downgrade"))
        .when(is_signup & (value > 150), F.lit("Cancellation Confirmation"))
        .when(is_signup, F.lit("Add Friend"))
    )


def _sessions(ev: DataFrame) -> DataFrame:
    """Session number per (user_id, day) of stretched time.

    A session breaks where two consecutive events of a user are more than
    24 h apart. Such a gap can never fall inside one 24-hour bucket, so it
    is enough to compare each active day's first event with the previous
    active day's last one. The window therefore runs over user-days, whose
    count per user is bounded by the calendar, not by the event volume: a
    user holding a third of all events does not land in one task.
    """
    days = ev.groupBy("user_id", "day").agg(F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))
    w = Window.partitionBy("user_id").orderBy("day")
    starts = F.coalesce(F.col("first_us") - F.lag("last_us").over(w) > F.lit(SESSION_GAP_US), F.lit(True))
    return days.select(
        "user_id",
        "day",
        F.sum(starts.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("sessionId"),
    )


# The raw type each page comes from (FIXTURES.md D1).
RAW_TYPE = {
    "NextSong": "view",
    "Error": "error",
    "Add to Playlist": "purchase",
    "Thumbs Down": "click",
    "Thumbs Up": "click",
    "Downgrade": "signup",
    "Cancellation Confirmation": "signup",
    "Add Friend": "signup",
}


def load_events(spark: SparkSession, sf_dir: str, attrs: bool = True, page: str | None = None) -> DataFrame:
    """SRC3: the driver's ``events`` table as a canonical event frame.

    ``page`` keeps the raw type that the page comes from (sessions are
    still those of all events), as a filter that reaches the scan; the
    caller filters on the page itself.

    ``attrs=False`` leaves out gender, location and level, so queries that
    do not need them skip the join with customer / nation / region. The
    plan is built on every call, so files added to the table are seen.
    """
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = _epoch_micros(F.col("ts"), raw.schema["ts"].dataType)
    t_us = F.lit(ORIGIN_US) + F.lit(STRETCH) * (micros - F.lit(ORIGIN_US))
    ev = raw.select(
        F.col("event_id").alias("seq"),
        "user_id",
        "event_type",
        "value",
        t_us.alias("t_us"),
    ).withColumn("day", F.floor(F.col("t_us") / F.lit(DAY_US)))

    sessions = _sessions(ev)
    if page is not None:
        ev = ev.where(F.col("event_type") == RAW_TYPE[page])
    ev = ev.join(sessions, ["user_id", "day"], "left")

    user_id = F.col("user_id")
    out = ev.select(
        F.when(user_id % BLANK_USER_MODULUS == BLANK_USER_REMAINDER, F.lit(""))
        .otherwise(user_id.cast("string"))
        .alias("userId"),
        F.col("sessionId").cast("long").alias("sessionId"),
        F.floor(F.col("t_us") / F.lit(1000)).cast("long").alias("ts"),
        _page_of(F.col("event_type"), F.col("value")).alias("page"),
        F.col("seq").cast("long").alias("seq"),
        F.when(F.col("event_type") == "error", F.lit(404)).otherwise(F.lit(200)).alias("status"),
        user_id.alias("_user_id"),
    )
    if not attrs:
        return out.drop("_user_id")

    # The keys below are primary keys. Grouping by them changes no value but
    # makes the uniqueness visible to the optimizer, which then removes the
    # attribute join from every plan that uses none of its columns (for
    # example the session and day branches of the user matrix). Customer is
    # grouped on numeric columns only, so the aggregate stays hash-based;
    # the string maxima run over the 25 nations and 5 regions.
    customer = (
        spark.read.parquet(f"{sf_dir}/customer.parquet")
        .groupBy(F.col("c_custkey").alias("_user_id"))
        .agg(F.max("c_nationkey").alias("c_nationkey"), F.max("c_acctbal").alias("c_acctbal"))
    )
    nation = (
        spark.read.parquet(f"{sf_dir}/nation.parquet")
        .groupBy("n_nationkey")
        .agg(F.max("n_name").alias("n_name"), F.max("n_regionkey").alias("n_regionkey"))
    )
    region = spark.read.parquet(f"{sf_dir}/region.parquet").groupBy("r_regionkey").agg(F.max("r_name").alias("r_name"))
    # Strategies are left to the planner, which broadcasts a side only when
    # its measured size is under the broadcast threshold.
    cust = (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
        .join(region, F.col("n_regionkey") == region.r_regionkey, "left")
        .select(
            "_user_id",
            F.when(F.col("_user_id") % 2 == 0, F.lit("M"))
            .when(F.col("_user_id") % 2 != 0, F.lit("F"))
            .alias("gender"),
            F.concat(F.col("n_name"), F.lit(", "), F.left(F.col("r_name"), F.lit(2))).alias("location"),
            F.when(F.col("c_acctbal") > 0, F.lit("paid")).when(F.col("c_acctbal") <= 0, F.lit("free")).alias("level"),
        )
    )
    return out.join(cust, "_user_id", "left").select(
        "userId", "sessionId", "ts", "page", "seq", "gender", "location", "level", "status"
    )


def stream_events(spark: SparkSession, sf_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    """The driver's ``events`` table as a stream: userId, ts, page, seq, event_time.

    The columns of ``load_events`` that need no other row and no other
    table; read from the given files as they are, without a copy.
    """
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # as a pattern, since the stream source takes a plain path for a folder only
    files = f"{sf_dir}/{{events}}.parquet"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(max_files_per_trigger)).parquet(files)
    t_us = F.lit(ORIGIN_US) + F.lit(STRETCH) * (_epoch_micros(F.col("ts"), schema["ts"].dataType) - F.lit(ORIGIN_US))
    blank = F.col("user_id") % BLANK_USER_MODULUS == BLANK_USER_REMAINDER
    return raw.select(
        F.when(blank, F.lit("")).otherwise(F.col("user_id").cast("string")).alias("userId"),
        F.floor(t_us / F.lit(1000)).cast("long").alias("ts"),
        _page_of(F.col("event_type"), F.col("value")).alias("page"),
        F.col("event_id").cast("long").alias("seq"),
        F.timestamp_micros(t_us).alias("event_time"),
    )
