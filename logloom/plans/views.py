"""Log-shaped views of the test tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import records, timeline
from logloom.sources.scratch import written

LEVELS = {"error": "ERROR", "purchase": "WARN", "signup": "FATAL", "click": "INFO", "view": "DEBUG"}
#: Rules over the derived lines: each feature of the rule language occurs.
RULES = [
    {"id": "never", "severity": "critical", "subsystem": "other", "title": "No condition"},
    {"id": "other-family", "severity": "critical", "subsystem": "other", "title": "Another family", "any_of": ["amount"], "applies_to": ["legacy"]},
    {"id": "svc-one", "severity": "warning", "subsystem": "cameras", "title": "Errors of one", "component": "svc.1", "any_of": ["ERROR amount"]},
    {"id": "svc-two", "severity": "critical", "subsystem": "network", "title": "Errors of two", "component": "Svc.2", "all_of": ["error", "deviceipint"]},
    {"id": "busy", "severity": "info", "subsystem": "license", "title": "Busy purchases", "any_of": ["purchase"], "min_per_minute": 12},
    {"id": "svc-one", "severity": "info", "subsystem": "other", "title": "Same id", "component": "svc.1", "any_of": ["purchase"]},
    {"id": "signups", "severity": "noise", "subsystem": "other", "title": "Signups", "any_of": ["nothing", "signup amount"]},
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, event_id, line): each event as one line in the log format."""
    # a file of few row groups is few tasks, and lines are much larger and dearer than the rows they are made of
    tasks = max(spark.sparkContext.defaultParallelism * 3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").repartition(tasks, "event_id")
    level = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in LEVELS.items()))
    c = lambda x: F.col(x).cast("string") if isinstance(x, str) else x.cast("string")
    rest = F.concat(F.lit("[Svc."), c(F.col("user_id") % 7), F.lit("] "), "event_type", F.lit(" amount "), c(F.round(F.col("value") * 100).cast("long")), F.lit(" from 10.0."), c(F.col("user_id") % 4), F.lit("."), c(F.col("event_id") % 250), F.lit(":80 DeviceIpint."), c(F.col("user_id") % 20))
    line = F.concat(F.lit("~["), c("user_id"), F.lit("]; "), F.date_format("ts", "yyyy-MM-dd; HH:mm:ss.SSS"), F.lit("; "), level, F.lit("; "), rest)
    file = F.concat(F.lit("APP_HOST.svc"), c(F.col("user_id") % 5), F.lit(".log"))
    return e.select(file.alias("file"), "event_id", line.alias("line"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines' headers: every derived line is a record of its own."""
    return records.headers(log_lines(spark, sf_dir)).withColumn("rec_ord", F.col("event_id"))


def unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeline events, stored, as they are read several times."""
    return written(timeline.events(parsed(spark, sf_dir), ["event_id"]), "events")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.numbered(unnumbered(spark, sf_dir), ["event_id"])


def signatures(spark: SparkSession, sf_dir: str, sets: bool = True) -> DataFrame:
    """Signatures by hours, with a low storm threshold, since the test events are sparse; stored, as rules read them several times."""
    return written(records.signatures(parsed(spark, sf_dir), chars=13, storm=3, sets=sets), "signatures")


#: The same views in SQL.
LOG = """
  SELECT 'APP_HOST.svc' || (user_id % 5) || '.log' AS file, event_id, user_id, CAST(user_id AS VARCHAR) AS thread,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts, epoch_us(ts) // 1000 AS ts_ms,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'FATAL' WHEN 'click' THEN 'INFO' ELSE 'DEBUG' END AS level,
    'Svc.' || (user_id % 7) AS component,
    event_type || ' amount ' || CAST(round(value * 100) AS BIGINT) || ' from 10.0.' || (user_id % 4) || '.' || (event_id % 250) || ':80 DeviceIpint.' || (user_id % 20) AS message,
    '10.0.' || (user_id % 4) || '.' || (event_id % 250) || ':80' AS address
  FROM events"""
SIG = r"""substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '0x[0-9a-fA-F]+', '<ptr>', 'g'), '\b[0-9A-F]{{8,}}\b', '<hex>', 'g'), '\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}(?::\d+)?', '<addr>', 'g'), '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}', '<guid>', 'g'), '\b\d{{4}}-\d{{2}}-\d{{2}}\b', '<date>', 'g'), '\b\d+\b', '<n>', 'g'), ' ' || chr(9) || chr(13) || chr(160)), 1, 200)"""
COARSE = r"""lower(substr(regexp_replace(regexp_replace(regexp_replace({x}, '[0-9a-fA-F]{{8}}-[0-9a-fA-F-]{{27}}', '<id>', 'g'), '\b\d{{1,3}}(?:\.\d{{1,3}}){{3}}\b', '<ip>', 'g'), '\d+', '#', 'g'), 1, 120))"""
CLASS = "CASE WHEN level IN ('ERROR', 'FATAL') THEN 0 WHEN level IN ('WARN', 'WARNING') THEN 1 ELSE 2 END"
ORDERED = f"SELECT *, regexp_replace(file, '^APP_HOST\\.|\\.log$', '', 'g') AS service, {CLASS} AS cls, row_number() OVER (ORDER BY ts_ms, event_id) - 1 AS seq FROM ({LOG})"
SIGS = f"""
  SELECT signature, any_value(level) AS level, any_value(component) AS component, arg_min(substr(message, 1, 500), (file, event_id)) AS sample, count(*) AS count,
    min(ts) AS first_ts, max(ts) AS last_ts, min((file, event_id)) AS first_seen
  FROM (SELECT *, level || '|' || component || '|' || {SIG.format(x="message")} AS signature FROM ({LOG}) WHERE {CLASS} < 2)
  GROUP BY signature"""
PEAK = f"""
  SELECT signature, max(n) AS peak FROM (
    SELECT level || '|' || component || '|' || {SIG.format(x="message")} AS signature, substr(ts, 1, 13) AS h, count(*) AS n FROM ({LOG}) WHERE {CLASS} < 2 GROUP BY 1, 2) GROUP BY 1"""
