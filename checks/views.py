"""Hourly series derived from the driver tables, as DataFrames and as the same thing in SQL.

``events``: one zone per user, one row per hour between the zone's first and last event. Even
zones are moved to March 2024 and odd ones to October 2024, so both clock changes of New York lie
inside. Amounts are integer cents until one last division, so both engines agree bit for bit.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hourcast.functions import local_of
from hourcast.schema import SampleConfig

from .registry import rnd

TZ = "America/New_York"
BLOCK = 168
SEQ = ("load_est", "Temp_F", "CDD_cum_24h")
CFG = SampleConfig(lookback=48, history=72, week=24, test_frac=0.2, seq_cols=SEQ, position="clock")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ts_text(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def r6(c: str | Column, name: str | None = None) -> Column:
    return rnd(c, 6).alias(name or (c if isinstance(c, str) else "value"))


def _cents(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("user_id", "ts", "value")
    h = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200) / 3600)
    return ev.groupBy(F.col("user_id").alias("z"), h.alias("h")).agg(
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("c"))


def _dense(spark: SparkSession, d: str) -> DataFrame:
    """Every hour between a zone's first and last event with its cents. What is shuffled is one row for a zone and block of
    hours, holding the hours with an event; hours are unfolded after it, so the hours of a day lie in one partition."""
    cents = _cents(spark, d)
    span = cents.groupBy("z").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    held = (cents.where("h IS NOT NULL").groupBy("z", F.floor(F.col("h") / BLOCK).alias("b"))
            .agg(F.map_from_entries(F.collect_list(F.struct("h", "c"))).alias("cs")))
    blocks = span.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor(F.col("hi") / BLOCK))))
    # A block is few bytes and many hours, so tasks must not be merged by their bytes.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hours = F.sequence(F.greatest("lo", F.col("b") * BLOCK), F.least("hi", F.col("b") * BLOCK + BLOCK - 1))
    return (blocks.repartition(parts, "z", "b").join(held, ["z", "b"], "left").withColumn("h", F.explode(hours))
            .select("z", "lo", "hi", "h", F.try_element_at("cs", "h").alias("c")))


def _decorate(df: DataFrame) -> DataFrame:
    h, z, c = F.col("h"), F.col("z"), F.coalesce("c", F.lit(0))
    shift = F.when(z % 2 == 0, 60).otherwise(293)
    wave = 1000 + 10 * (h % 24) + (h * 7) % 50
    ts = F.timestamp_seconds(F.lit(1704067200) + (h + 24 * shift) * 3600)
    flag = (F.when(h > F.col("hi") - 30, "False").when(h % 50 == 7, "no").when(h % 3 == 0, " TRUE")
            .otherwise("1"))
    return df.select(
        z.cast("string").alias("zone"), "h", "lo", "hi", ts.alias("ts_utc"),
        local_of(ts, TZ).alias("ts_local"),
        (wave + c / F.lit(100.0)).alias("load"),
        (wave + F.floor(c * 97 / 100) / F.lit(100.0)).alias("load_est"),
        (30 + z % 10 + h % 24 + (F.floor(h / 24) * 3) % 41).cast("double").alias("Temp_F"),
        (30 + (h * 13) % 70).cast("double").alias("RelativeHumidity_pct"),
        flag.alias("is_verified"), (h % 97 != 0).cast("int").alias("is_valid"))


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """Dense hours of every zone."""
    return _decorate(_dense(spark, d))


def hourly_sparse(spark: SparkSession, d: str) -> DataFrame:
    """Only hours with an event: real gaps."""
    cents = _cents(spark, d)
    span = cents.groupBy("z").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    return _decorate(cents.join(span, "z"))


def calendar_hourly(spark: SparkSession, d: str) -> DataFrame:
    """``hourly`` with the calendar columns a sample needs."""
    from hourcast.operators.quality import add_calendar
    return add_calendar(hourly(spark, d))


def tail_unlabelled(spark: SparkSession, d: str) -> DataFrame:
    """``hourly`` whose last 48 hours have no label, with some impossible values inside."""
    load = (F.when(F.col("h") > F.col("hi") - 48, None)
            .when((F.col("h") % 61 == 5) & (F.col("zone").cast("int") % 3 != 1), 0.0)
            .when(F.col("h") % 89 == 3, None).otherwise(F.col("load")))
    return hourly(spark, d).withColumn("load", load)


def forecast(spark: SparkSession, d: str) -> DataFrame:
    """Forecast archive of the hourly view: both leads, with holes and repeated shard rows."""
    base = hourly(spark, d).select("zone", "h", "Temp_F", "ts_local")
    one = base.groupBy("zone", F.col("ts_local").alias("valid_local")).agg(
        F.min("h").alias("h"), F.min("Temp_F").alias("t"))
    leads = one.withColumn("lead_day", F.explode(F.array(F.lit(1), F.lit(2))))
    shard = F.explode(F.when(F.col("h") % 50 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))))
    out = leads.withColumn("file", shard).withColumn(
        "Temp_F", F.when((F.col("h") % 211 == 5) & (F.col("lead_day") == 2), None)
        .otherwise(F.col("t") + (F.col("h") * F.col("lead_day")) % 3 + F.when(F.col("file") == "b", 9.0).otherwise(0.0)))
    return out.select("zone", F.date_sub(F.to_date("valid_local"), F.col("lead_day")).alias("issue_date"),
                      "lead_day", "valid_local", "Temp_F", "file")


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Days of ``orders`` per priority: temperature by season, amount in cents, first 80 % train."""
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderdate", "o_totalprice")
    days = o.groupBy(F.col("o_orderpriority").alias("zone"), F.to_date("o_orderdate").alias("local_date")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("c"))
    temp = 20 + (F.dayofyear("local_date") * 7) % 80 + (F.col("c") % 11)
    return days.select("zone", "local_date", F.when(F.col("c") % 17 != 0, temp.cast("double")).alias("temp_mean"),
                       (F.col("local_date") < F.lit("2000-04-01").cast("date")).alias("is_train"),
                       (F.col("c") / F.lit(100.0)).alias("amount"))


BASE = f"""
cents AS (
  SELECT user_id AS z, date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS h,
         CAST(SUM(CAST(ROUND(value*100) AS BIGINT)) AS BIGINT) AS c
  FROM events GROUP BY 1, 2),
span AS (SELECT z, MIN(h) AS lo, MAX(h) AS hi FROM cents GROUP BY 1),
grid AS (SELECT z, lo, hi, unnest(range(lo, hi + 1)) AS h FROM span),
{{name}} AS (
  SELECT *, timezone('{TZ}', timezone('UTC', ts_utc)) AS lt,
         CAST(timezone('{TZ}', timezone('UTC', ts_utc)) AS DATE) AS ld,
         hour(timezone('{TZ}', timezone('UTC', ts_utc))) AS hr,
         CAST(floor(epoch(ts_utc) / 3600) AS BIGINT) AS p
  FROM (
    SELECT CAST(g.z AS VARCHAR) AS zone, g.z AS z, g.h AS h, g.lo AS lo, g.hi AS hi,
      TIMESTAMP '2024-01-01' + to_hours(g.h + 24 * CASE WHEN g.z % 2 = 0 THEN 60 ELSE 293 END) AS ts_utc,
      1000 + 10 * (g.h % 24) + (g.h * 7) % 50 + COALESCE(c.c, 0) / 100.0::DOUBLE AS load,
      1000 + 10 * (g.h % 24) + (g.h * 7) % 50 + (COALESCE(c.c, 0) * 97 // 100) / 100.0::DOUBLE AS load_est,
      CAST(30 + g.z % 10 + g.h % 24 + ((g.h // 24) * 3) % 41 AS DOUBLE) AS t,
      CAST(30 + (g.h * 13) % 70 AS DOUBLE) AS rh,
      CASE WHEN g.h > g.hi - 30 THEN 'False' WHEN g.h % 50 = 7 THEN 'no' WHEN g.h % 3 = 0 THEN ' TRUE' ELSE '1' END AS is_verified,
      CAST(g.h % 97 <> 0 AS INTEGER) AS is_valid
    FROM grid g {{join}} JOIN cents c ON c.z = g.z AND c.h = g.h))"""
HOURLY = BASE.format(name="hourly", join="LEFT")
SPARSE = BASE.format(name="sparse", join="INNER")
TAIL = HOURLY + """,
tail AS (
  SELECT * REPLACE (CASE WHEN h > hi - 48 THEN NULL WHEN h % 61 = 5 AND z % 3 <> 1 THEN 0.0
                         WHEN h % 89 = 3 THEN NULL ELSE load END AS load) FROM hourly)"""
FORECAST = HOURLY + """,
fc_one AS (SELECT zone, lt AS valid_local, MIN(h) AS h, MIN(t) AS t FROM hourly GROUP BY 1, 2),
fc_lead AS (SELECT *, unnest([1, 2]) AS lead_day FROM fc_one),
fc_raw AS (SELECT *, unnest(CASE WHEN h % 50 = 0 THEN ['a', 'b'] ELSE ['a'] END) AS file FROM fc_lead),
fc0 AS (
  SELECT zone, CAST(valid_local AS DATE) - lead_day AS issue_date, lead_day, valid_local, file,
    CASE WHEN h % 211 = 5 AND lead_day = 2 THEN NULL
         ELSE t + (h * lead_day) % 3 + CASE WHEN file = 'b' THEN 9.0 ELSE 0.0 END END AS t
  FROM fc_raw),
fc AS (
  SELECT *, CAST(COUNT(t) OVER (PARTITION BY zone, issue_date) = 48 AS INTEGER) AS is_complete
  FROM (SELECT * FROM fc0 QUALIFY ROW_NUMBER() OVER (PARTITION BY zone, valid_local, lead_day ORDER BY file) = 1))"""
DAILY = """
day_cents AS (
  SELECT o_orderpriority AS zone, CAST(o_orderdate AS DATE) AS local_date,
         CAST(SUM(CAST(ROUND(o_totalprice*100) AS BIGINT)) AS BIGINT) AS c
  FROM orders GROUP BY 1, 2),
daily AS (
  SELECT zone, local_date, c, c / 100.0::DOUBLE AS amount,
    CASE WHEN c % 17 <> 0 THEN CAST(20 + (dayofyear(local_date) * 7) % 80 + c % 11 AS DOUBLE) END AS temp_mean,
    local_date < DATE '2000-04-01' AS is_train
  FROM day_cents)"""


def index_sql(lookback: int = 48, history: int = 72, cutoff_hour: int = 0) -> str:
    """``idx``: usable samples; ``idx_all``: with status."""
    back = 1 if cutoff_hour <= 9 else 2
    return f""",
day_rows AS (
  SELECT zone, ld AS d, COUNT(*) AS n, MIN(p) AS first_p,
         MIN(CASE WHEN hr = {cutoff_hour} THEN p END) AS cut FROM hourly GROUP BY 1, 2),
idx_all AS (
  SELECT zone, d AS target_day, cutoff, z0,
    CASE WHEN cutoff IS NULL THEN 'no_cutoff' WHEN cutoff - z0 < {max(lookback, history)} THEN 'short' ELSE 'ok' END AS status
  FROM (SELECT zone, d, LAG(cut, {back}) OVER w AS cutoff, LAG(d) OVER w AS prev,
               MIN(first_p) OVER (PARTITION BY zone) AS z0
        FROM day_rows WINDOW w AS (PARTITION BY zone ORDER BY d))
  WHERE prev IS NOT NULL),
idx AS (SELECT * FROM idx_all WHERE status = 'ok')"""


TARGETS = """,
tgt_n AS (SELECT zone, ld AS d, COUNT(*) AS n, MIN(is_valid) AS ok FROM hourly GROUP BY 1, 2),
tgt_rows AS (
  SELECT h.zone, n.d, n.n, h.hr, h.load,
         ROW_NUMBER() OVER (PARTITION BY h.zone, n.d ORDER BY h.ts_utc) - 1 AS k
  FROM hourly h JOIN tgt_n n ON n.zone = h.zone AND n.d = h.ld WHERE n.n IN (23, 24, 25)),
tgt_seen AS (
  SELECT zone, d, CASE WHEN n = 24 THEN k ELSE hr END AS slot, AVG(load) AS v FROM tgt_rows GROUP BY 1, 2, 3),
tgt_all AS (
  SELECT f.zone, f.d, f.n, f.slot,
    COALESCE(s.v, CASE WHEN f.n = 23 THEN COALESCE((a.v + b.v) / 2, a.v, b.v) END) AS y
  FROM (SELECT zone, d, n, unnest(range(24)) AS slot FROM tgt_n WHERE n IN (23, 24, 25)) f
  LEFT JOIN tgt_seen s ON s.zone = f.zone AND s.d = f.d AND s.slot = f.slot
  LEFT JOIN tgt_seen a ON a.zone = f.zone AND a.d = f.d AND a.slot = f.slot - 1
  LEFT JOIN tgt_seen b ON b.zone = f.zone AND b.d = f.d AND b.slot = f.slot + 1),
tgt AS (SELECT * FROM tgt_all QUALIFY COUNT(y) OVER (PARTITION BY zone, d) = 24)"""


def errors_sql(lookback: int = 48, history: int = 72) -> str:
    """``errors`` of the naive baseline with the given window."""
    return HOURLY + index_sql(lookback, history) + TARGETS + f""",
base AS (
  SELECT i.zone, i.target_day, h.hr AS slot, AVG(h.load_est) AS b
  FROM idx i JOIN hourly h ON h.zone = i.zone AND h.p < i.cutoff AND h.p >= i.cutoff - {lookback}
  GROUP BY 1, 2, 3),
errors AS (
  SELECT b.zone, 'baseline' AS model, b.target_day AS date, b.slot AS hour,
    CAST(b.target_day AS TIMESTAMP) + to_hours(b.slot) AS datetime, t.y AS true_load, b.b AS pred,
    b.b - t.y AS signed_error, ABS(b.b - t.y) AS abs_error, ABS(b.b - t.y) / t.y * 100 AS mape_pct,
    isodow(b.target_day) - 1 AS day_of_week, day(b.target_day) AS day_of_month
  FROM base b JOIN tgt t ON t.zone = b.zone AND t.d = b.target_day AND t.slot = b.slot)"""


ERRORS = errors_sql()


def errors(spark: SparkSession, d: str) -> DataFrame:
    """Hourly errors of the naive baseline."""
    from hourcast.plans.evaluate import naive_errors
    return naive_errors(hourly(spark, d), CFG)
