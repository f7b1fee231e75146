"""Resumable event streams, folding of failures, states over micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import text as X
from corpusmill.sources import versions as V
from corpusmill.sources.tables import read, shared_path, written
from corpusmill.streaming import leases


def source(spark: SparkSession, folder: str, table: str = "events") -> DataFrame:
    """The table as a stream of files; new files are new events, and the checkpoint is the offset."""
    schema = read(spark, folder, table).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{folder}/{table}.parquet*")


def drained(stream: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """All that is there now, appended to a table: the same checkpoint resumes after what it has seen."""
    spark = stream.sparkSession
    out = shared_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint or f"{out}-offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def latest_state(stream: DataFrame, name: str, keys: tuple[str, ...] = (), order: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """The result of an aggregation over all that is there now. With `keys` the stream tells changes, and the last one of
    each key holds, whichever micro-batch brought it, by `order` where a micro-batch may tell several; without, each
    micro-batch tells the whole result. With a checkpoint of its own a stream goes on where it was; what is given then
    are the changes since.

    Every micro-batch has a folder of its own, so one that is repeated replaces itself."""
    spark = stream.sparkSession
    out = shared_path(spark, name)
    spark.createDataFrame([], stream.schema).write.parquet(f"{out}/_batch=-1")
    keep = lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/_batch={batch}")
    query = stream.writeStream.outputMode("update" if keys else "complete").foreachBatch(keep).option("checkpointLocation", checkpoint or shared_path(spark, f"{name}-offsets")).trigger(availableNow=True).start()
    query.awaitTermination()
    columns = stream.columns
    batches = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])).option("basePath", out).parquet(f"{out}/_batch=*")
    if keys:
        last = F.struct("_batch", *([order] if order else []))
        return batches.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in columns if c not in keys]), last).alias("_last")).select(*keys, "_last.*").select(*columns)
    last = batches.agg(F.max("_batch").alias("_last"))
    return batches.join(F.broadcast(last), F.col("_batch") == F.col("_last")).select(*columns)


def split_late(stream: DataFrame, time: str, delay_seconds: int, name: str, checkpoint: str | None = None, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(on time, late): rows of a stream by whether they came before the watermark that earlier micro-batches had set, which
    is the largest time so far less the delay. Rows without a time are late.

    Each micro-batch has a folder of its own on either side and notes the largest time so far, so one that is repeated
    replaces itself; with a checkpoint and a store of its own a stream goes on where it was."""
    spark = stream.sparkSession
    out = store or shared_path(spark, name)

    def split(df: DataFrame, batch: int) -> None:
        marks = V.numbered(spark, f"{out}/marks")
        high = max((int(V.read_text(spark, f"{out}/marks/{n:012d}")) for n in marks if n < batch), default=None)
        micros = F.unix_micros(F.col(time).cast("timestamp"))
        late = F.col(time).isNull() | (F.lit(False) if high is None else micros < high - delay_seconds * 1_000_000)
        told = written(df.withColumn("_late", late), "micro-batch")
        told.where("NOT _late").drop("_late").write.mode("overwrite").parquet(f"{out}/on-time/_batch={batch}")
        told.where("_late").drop("_late").write.mode("overwrite").parquet(f"{out}/late/_batch={batch}")
        top = told.agg(F.max(micros)).first()[0]
        V.create_once(spark, f"{out}/marks/{batch:012d}", str(max(x for x in (top, high, -(1 << 62)) if x is not None)))

    stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint or shared_path(spark, f"{name}-offsets")).trigger(availableNow=True).start().awaitTermination()
    schema = stream.schema
    both = [spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{out}/{side}") if V.numbered(spark, f"{out}/marks") else spark.createDataFrame([], schema) for side in ("on-time", "late")]
    return both[0], both[1]


#: How long before a completion a cancel of the same item counts.
RACE = "2 days"


def cancel_race(completes: DataFrame, cancels: DataFrame, delay: str, within: str = RACE) -> DataFrame:
    """completes (event_id, item, at) and cancels (item, at), two streams -> event_id, item, at, cancel_at: an outer join
    over an interval, under the watermarks of both. A completion without a cancel comes out when neither stream can bring
    one any more; one with several has a row for each."""
    left = completes.withWatermark("at", delay)
    right = cancels.select(F.col("item").alias("_item"), F.col("at").alias("cancel_at")).withWatermark("cancel_at", delay)
    met = F.expr(f"item = _item AND cancel_at <= at AND cancel_at >= at - INTERVAL {within}")
    return left.join(right, met, "left_outer").select("event_id", "item", "at", "cancel_at")


def outcomes(raced: DataFrame) -> DataFrame:
    """One row for each completion: cancelled if a cancel came no later."""
    return raced.groupBy("event_id", "item", "at").agg(F.when(F.count("cancel_at") > 0, "cancelled").otherwise("completed").alias("outcome"))


def resumed(events: DataFrame, after: int) -> DataFrame:
    """Events past an offset that a reader brings."""
    return events.where(F.col("event_id") > after)


def offset_of(after_sequence: int | None, last_event_id: str | None) -> int:
    """The later of two offsets; a header that is no number counts as none."""
    header = int(last_event_id) if last_event_id and last_event_id.strip().isdigit() else 0
    return max(after_sequence or 0, header)


def folded(events: DataFrame) -> DataFrame:
    """Failures by fingerprint: how many, the first and the last."""
    message = F.concat(F.lit("User "), F.col("user_id") + 10000, F.lit("  failed on shard "), F.col("user_id") % 7)
    fp = X.error_fingerprint(F.lit("p"), F.lit("runtime"), F.lit(None).cast("string"), message)
    return events.where("event_type = 'error'").groupBy(fp.alias("fingerprint")).agg(F.count("*").alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def stream_event_resume(spark: SparkSession, d: str) -> DataFrame:
    return drained(resumed(source(spark, d), offset_of(200, "300")), "resumed").select("event_id", "event_type", "user_id")


def stream_filtered_events(spark: SparkSession, d: str) -> DataFrame:
    """The events of one segment's customers: a stream joined to a table."""
    c = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return drained(source(spark, d).join(c, "user_id").select("event_id", "user_id"), "filtered")


def stream_issue_fold(spark: SparkSession, d: str) -> DataFrame:
    return latest_state(folded(source(spark, d)), "folded")


def stream_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """The first message of each external key within the watermark."""
    keyed = source(spark, d).select((F.col("event_id") % 250).alias("external_id"), F.col("ts").cast("timestamp").alias("ts"))
    return drained(keyed.withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["external_id"]).select("external_id"), "deduplicated")


def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and kind."""
    e = source(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "event_type").withWatermark("ts", "1 day")
    counted = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return latest_state(counted, "windows").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


#: Lease of the query below, in milliseconds, and how late commands may come.
LEASE_MS, LATE = 12 * 3600 * 1000, "1 hour"


def queue_commands(events: DataFrame) -> DataFrame:
    """Events as commands of workers: six items for each user, five days each."""
    kind = (
        F.when(F.col("event_id") % 7 == 0, "cancel").when(F.col("event_type").isin("view", "signup"), "claim").when(F.col("event_type") == "click", "heartbeat")
        .when(F.col("event_type") == "purchase", "complete").otherwise("fail")
    )
    at = F.col("ts").cast("timestamp")
    return events.select((F.col("user_id") * 7 + F.floor((F.dayofmonth(at) - 1) / 5)).alias("item"), at.alias("at"), F.col("event_id").alias("n"), kind.alias("kind"))


def stream_queue_leases(spark: SparkSession, d: str) -> DataFrame:
    """The last state of each item that ever changed, as of the last slot that the watermark has passed."""
    with leases.stored(spark):
        changed = latest_state(leases.leases(queue_commands(source(spark, d)), LEASE_MS, LATE), "leases", ("item",), "changes")
    return changed.select("item", "status", "attempts")


def stream_cancel_race(spark: SparkSession, d: str) -> DataFrame:
    """Purchases against clicks of the same user, up to the day that both streams have left behind."""
    e = lambda kind: source(spark, d).where(F.col("event_type") == kind).select("event_id", F.col("user_id").alias("item"), F.col("ts").cast("timestamp").alias("at"))
    told = outcomes(drained(cancel_race(e("purchase"), e("click"), "1 hour"), "race"))
    last = read(spark, d, "events").where("event_type IN ('purchase', 'click')").groupBy("event_type").agg(F.max("ts").alias("ts"))
    settled = last.agg(F.date_trunc("day", F.min("ts").cast("timestamp") - F.expr("INTERVAL 1 HOUR")).alias("settled"))  # one row
    return told.join(F.broadcast(settled), F.col("at") < F.col("settled")).select("event_id", "item", "outcome")


QUERIES = {f.__name__: f for f in (stream_event_resume, stream_filtered_events, stream_issue_fold, stream_deduplicated, stream_event_windows, stream_queue_leases, stream_cancel_race)}
ORACLE = {
    "stream_event_resume": "SELECT event_id, event_type, user_id FROM events WHERE event_id > 300",
    "stream_filtered_events": "SELECT event_id, user_id FROM events JOIN customer ON c_custkey = user_id WHERE c_mktsegment = 'BUILDING'",
    "stream_issue_fold": "SELECT sha256('p|runtime||user {id} failed on shard ' || user_id % 7) AS fingerprint, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen FROM events WHERE event_type = 'error' GROUP BY 1",
    "stream_deduplicated": "SELECT DISTINCT event_id % 250 AS external_id FROM events",
    "stream_queue_leases": f"""WITH RECURSIVE settled AS (SELECT (epoch_ms(max(ts)) - 3600000 + 1) // {LEASE_MS // 8} * {LEASE_MS // 8} - 1 AS edge FROM events),
        c AS (SELECT user_id * 7 + (day(ts) - 1) // 5 AS item, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id * 7 + (day(ts) - 1) // 5 ORDER BY epoch_ms(ts), event_id) AS rn,
              CASE WHEN event_id % 7 = 0 THEN 'cancel' WHEN event_type IN ('view', 'signup') THEN 'claim' WHEN event_type = 'click' THEN 'heartbeat' WHEN event_type = 'purchase' THEN 'complete' ELSE 'fail' END AS kind
              FROM events, settled WHERE epoch_ms(ts) <= edge),
        s AS (SELECT DISTINCT item, CAST(0 AS BIGINT) AS rn, 'queued' AS status, CAST(0 AS BIGINT) AS attempts, CAST(0 AS BIGINT) AS until, false AS cancel FROM c
            UNION ALL SELECT item, rn,
                CASE WHEN status = 'queued' AND kind = 'claim' AND t >= until THEN 'leased' WHEN status = 'queued' AND kind = 'cancel' THEN 'cancelled' WHEN status <> 'leased' THEN status
                     WHEN kind IN ('complete', 'fail') AND cancel THEN 'cancelled' WHEN kind = 'complete' THEN 'done' WHEN kind = 'fail' AND attempts < 3 THEN 'queued' WHEN kind = 'fail' THEN 'failed' ELSE status END,
                CASE WHEN status = 'queued' AND kind = 'claim' AND t >= until THEN attempts + 1 ELSE attempts END,
                CASE WHEN status = 'queued' AND kind = 'claim' AND t >= until THEN t + {LEASE_MS} WHEN status = 'leased' AND kind = 'heartbeat' THEN t + {LEASE_MS}
                     WHEN status = 'leased' AND kind = 'fail' AND NOT cancel AND attempts < 3 THEN t + CAST(1000 * least(60, 2 ** greatest(0, attempts - 1)) AS BIGINT) ELSE until END,
                status = 'leased' AND (cancel OR kind = 'cancel')
              FROM (SELECT c.item, c.rn, c.t, c.kind, s.attempts,
                CASE WHEN s.status = 'leased' AND c.t >= s.until THEN CASE WHEN s.cancel THEN 'cancelled' ELSE 'queued' END ELSE s.status END AS status,
                CASE WHEN s.status = 'leased' AND c.t >= s.until AND NOT s.cancel THEN s.until + CAST(1000 * least(60, 2 ** greatest(0, s.attempts - 1)) AS BIGINT) ELSE s.until END AS until,
                s.cancel AND NOT (s.status = 'leased' AND c.t >= s.until) AS cancel FROM s JOIN c ON c.item = s.item AND c.rn = s.rn + 1))
        SELECT item, CASE WHEN status = 'leased' AND until <= edge THEN CASE WHEN cancel THEN 'cancelled' ELSE 'queued' END ELSE status END AS status, attempts
        FROM (SELECT item, max_by(status, rn) AS status, max_by(attempts, rn) AS attempts, max_by(until, rn) AS until, max_by(cancel, rn) AS cancel, bool_or(status <> 'queued') AS changed FROM s GROUP BY item), settled
        WHERE changed""",
    "stream_cancel_race": """WITH settled AS (SELECT date_trunc('day', min(t) - INTERVAL 1 HOUR) AS edge FROM (SELECT max(ts) AS t FROM events WHERE event_type IN ('purchase', 'click') GROUP BY event_type))
        SELECT event_id, user_id AS item, CASE WHEN EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND c.ts <= p.ts AND c.ts >= p.ts - INTERVAL 2 DAYS) THEN 'cancelled' ELSE 'completed' END AS outcome
        FROM events p, settled WHERE event_type = 'purchase' AND ts < edge""",
    "stream_event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
