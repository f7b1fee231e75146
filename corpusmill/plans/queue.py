"""Queues, issues, audits and access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import rules as R
from corpusmill.functions import text as X
from corpusmill.operators import windows as W
from corpusmill.sources.tables import read

AS_OF = "1998-08-02"


def _day(text: str) -> F.Column:
    return F.lit(text).cast("timestamp_ntz")


def queue_status(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


def queue_oldest_wait(spark: SparkSession, d: str) -> DataFrame:
    """Seconds that the oldest open item of each queue has waited, 0 at least."""
    oldest = F.min(F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate").cast("timestamp_ntz")))
    q = read(spark, d, "orders").groupBy("o_orderpriority").agg(oldest.alias("oldest"), F.count("*").alias("n"))
    wait = F.timestamp_diff("SECOND", F.col("oldest"), _day(AS_OF))
    return q.select("o_orderpriority", "n", F.greatest(F.lit(0), wait).cast("long").alias("wait_seconds"))


def queue_claimable(spark: SparkSession, d: str) -> DataFrame:
    """Items that may be claimed: the first open one of each conversation, if it is queued and due."""
    open_ = read(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P"))
    first = W.latest(open_, ["o_custkey"], [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()])
    due = first.where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") <= _day(AS_OF)))
    return due.select("o_orderkey", "o_custkey", "o_orderpriority")


def queue_next(spark: SparkSession, d: str) -> DataFrame:
    """The next items to claim, by priority and age."""
    return queue_claimable(spark, d).orderBy("o_orderpriority", "o_orderkey").limit(20)


def queue_missing_items(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an item in one of the queues: tasks that have no queue item."""
    items = read(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").select("c_custkey").join(items, "c_custkey", "left_anti")


def no_active_run(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders, none of which is pending."""
    o = read(spark, d, "orders")
    c = read(spark, d, "customer").select("c_custkey")
    some = o.select(F.col("o_custkey").alias("c_custkey"))
    return c.join(some, "c_custkey", "left_semi").join(o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


def queue_backoff(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"))
    return l.select("l_linenumber", "n", R.retry_seconds(F.col("l_linenumber")).alias("retry_seconds"), R.retry_minutes(F.col("l_linenumber"), F.lit(120)).alias("retry_minutes"))


def issue_dashboard_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Total and four one-key counts in one pass; a missing key is named, and told apart from the total."""
    e = read(spark, d, "events")
    rows = e.selectExpr("event_type AS status", "CASE WHEN value > 90 THEN 'high' WHEN value > 50 THEN 'low' END AS severity", "CASE user_id % 3 WHEN 0 THEN 'external' WHEN 1 THEN 'internal' END AS boundary")
    keys = ["status", "severity", "boundary"]
    counted = rows.groupingSets([[], *([k] for k in keys)], *keys).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    measure = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "status").when(F.col("g") == 5, "severity").otherwise("boundary")
    named = lambda k, none: F.coalesce(k, F.lit(none))
    value = F.when(F.col("g") == 7, "all").when(F.col("g") == 3, named("status", "unclassified")).when(F.col("g") == 5, named("severity", "unclassified")).otherwise(named("boundary", "undetermined"))
    return counted.select(measure.alias("measure"), value.alias("value"), "n")


def issue_fold_by_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Failures folded to issues: numbers in messages do not tell them apart."""
    e = read(spark, d, "events").where("event_type = 'error'")
    message = F.concat(F.lit("User "), F.col("user_id") + 10000, F.lit("  failed on shard "), F.col("user_id") % 7)
    fp = X.error_fingerprint(F.lit("p"), F.lit("runtime"), F.lit(None).cast("string"), message)
    rows = e.select(fp.alias("fingerprint"), "ts", "event_id", "user_id")
    return rows.groupBy("fingerprint").agg(F.count("*").alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("user_id", F.struct("ts", "event_id")).alias("last_user"))


def issue_boundary(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.element_at(F.array(*map(F.lit, ("Access DENIED for", "redis timeout at", "policy_scope of", "wrong total in", "network permission denied"))), (F.col("o_orderkey") % 5 + 1).cast("int")), F.lit(" "), "o_orderpriority")
    o = read(spark, d, "orders").withColumn("b", R.boundary(text))
    return o.groupBy("b.boundary", "b.confidence").agg(F.count("*").alias("n"), F.sum(R.severity_priority(F.lower(F.substring_index("o_orderpriority", "-", -1)))).alias("priority"))


COMMANDS = (
    "git status", "rm -fr /tmp", "git reset --hard", "pytest -q", "curl x", " npm run build", "format c:", "svn info", "RM -R x", "rmdir /s x", "git clean -fd", "diskpart", "cipher /w", "git log -3", "git diff", "python -m pytest t",
    "git clone u", "git push", "svn export u", "svn commit", "pnpm test", "npm publish", "Get-Content f", "tesseract ocr", "rgx y", "rg x", "rm file", "information", "git reset --soft", "sudo rm -r /", "echo git status", "npm run format",
)


def command_policy(spark: SparkSession, d: str) -> DataFrame:
    """Commands of every kind that the policy tells apart, and near misses."""
    command = F.element_at(F.array(*map(F.lit, COMMANDS)), (F.col("p_partkey") % len(COMMANDS) + 1).cast("int"))
    p = read(spark, d, "part").select(command.alias("command"), F.when(F.col("p_size") % 9 == 0, "file_change").otherwise("command").alias("kind"))
    return p.groupBy("command", "kind", R.command_policy(F.col("command"), F.col("kind")).alias("decision")).agg(F.count("*").alias("n"))


def audit_task_summary(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("events"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("event_id").alias("last_event"))


def audit_event_join(spark: SparkSession, d: str) -> DataFrame:
    """Events of customers of one segment after a sequence number, in order."""
    c = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return read(spark, d, "events").where("event_id > 100").join(c, "user_id").orderBy("event_id").limit(500).select("event_id", "user_id", "event_type")


def idempotent_admission(spark: SparkSession, d: str) -> DataFrame:
    """The first request of a key is admitted; the same again is a replay, another one a conflict. Even turns come twice.

    The first request of each key is combined before the shuffle; no window holds the requests of a key."""
    c = read(spark, d, "conversations")
    rows = c.select(F.col("conv_id").alias("key"), "turn", F.sha2(F.concat_ws("\x1f", "role", "text"), 256).alias("hash"), F.explode(F.when(F.col("turn") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("attempt"))
    order = F.struct("attempt", "turn")
    first = rows.groupBy("key").agg(F.min_by("hash", order).alias("held"), F.min(order).alias("first"))
    outcome = F.when(order == F.col("first"), "admitted").when(F.col("hash") == F.col("held"), "replay").otherwise("conflict")
    return rows.join(first, "key").select("key", "turn", "attempt", outcome.alias("outcome"))


def cancel_vs_complete(spark: SparkSession, d: str) -> DataFrame:
    """Of two final decisions the earlier one holds; cancellation wins a tie."""
    l = read(spark, d, "lineitem").where("l_returnflag IN ('R', 'A')")
    rank = F.struct(F.col("l_shipdate"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1))
    return l.groupBy("l_orderkey").agg(F.min_by(F.when(F.col("l_returnflag") == "R", "cancelled").otherwise("completed"), rank).alias("decision"))


def access_filtered_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one tenant, or of the product versions of one product."""
    c, n, r = (read(spark, d, t) for t in ("customer", "nation", "region"))
    versions = n.join(r.where("r_name = 'ASIA'"), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("c_nationkey"))
    tenant = c.where("c_custkey % 3 = 0 AND c_nationkey = 7")
    product = c.where("c_custkey % 3 = 1").join(versions, "c_nationkey", "left_semi")
    return tenant.unionByName(product).select("c_custkey", "c_nationkey")


def learning_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Users with enough successes or failures to learn from."""
    kind = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "purchase", "success")
    e = read(spark, d, "events").select("user_id", kind.alias("kind")).where("kind IS NOT NULL")
    return e.groupBy("user_id", "kind").agg(F.count("*").alias("n")).where("(kind = 'success' AND n >= 3) OR (kind = 'failure' AND n >= 2)")


def promotion_state(spark: SparkSession, d: str) -> DataFrame:
    """Longest failure and success runs of each user, and what they lead to."""
    e = W.streaks(read(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") != "error")
    top = e.groupBy("user_id").agg(F.max("failures").alias("failures"), F.max("successes").alias("successes"))
    return top.withColumn("state", F.when(F.col("failures") >= 2, "rolled_back").when(F.col("successes") >= 10, "promoted").when(F.col("successes") >= 5, "canary").otherwise("shadow"))


def gate_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """All gates of a group hold, and there is at least one."""
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") > 5).alias("passed"), F.count("*").alias("gates"))


QUERIES = {f.__name__: f for f in (
    queue_status, queue_oldest_wait, queue_claimable, queue_next, queue_missing_items, no_active_run, queue_backoff, issue_dashboard_grouping_sets, issue_fold_by_fingerprint, issue_boundary, command_policy, audit_task_summary,
    audit_event_join, idempotent_admission, cancel_vs_complete, access_filtered_rows, learning_threshold, promotion_state, gate_evaluation,
)}

_CLAIM = f"""f AS (SELECT * FROM orders WHERE o_orderstatus IN ('O', 'P') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1),
q AS (SELECT o_orderkey, o_custkey, o_orderpriority FROM f WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '{AS_OF}')"""
_BOUND = """b AS (SELECT o_orderpriority, CASE o_orderkey % 5 WHEN 1 THEN 'external' WHEN 2 THEN 'scope' WHEN 3 THEN 'internal' ELSE 'credential' END AS boundary, CASE o_orderkey % 5 WHEN 1 THEN 0.88 WHEN 2 THEN 0.95 WHEN 3 THEN 0.84 ELSE 0.96 END AS confidence FROM orders)"""
ORACLE = {
    "queue_status": "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2",
    "queue_oldest_wait": f"SELECT o_orderpriority, count(*) AS n, greatest(0, date_diff('second', min(o_orderdate) FILTER (WHERE o_orderstatus <> 'F'), TIMESTAMP '{AS_OF}')) AS wait_seconds FROM orders GROUP BY 1",
    "queue_claimable": f"WITH {_CLAIM} SELECT * FROM q",
    "queue_next": f"WITH {_CLAIM} SELECT * FROM q ORDER BY o_orderpriority, o_orderkey LIMIT 20",
    "queue_missing_items": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0)",
    "no_active_run": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "queue_backoff": "SELECT l_linenumber, count(*) AS n, CAST(least(60, pow(2, l_linenumber - 1)) AS BIGINT) AS retry_seconds, CAST(least(120, 5 * pow(2, least(l_linenumber - 1, 6))) AS BIGINT) AS retry_minutes FROM lineitem GROUP BY l_linenumber",
    "issue_dashboard_grouping_sets": """WITH i AS (SELECT event_type AS status, CASE WHEN value > 90 THEN 'high' WHEN value > 50 THEN 'low' END AS severity, CASE user_id % 3 WHEN 0 THEN 'external' WHEN 1 THEN 'internal' END AS boundary FROM events)
      SELECT 'total' AS measure, 'all' AS value, count(*) AS n FROM i UNION ALL SELECT 'status', coalesce(status, 'unclassified'), count(*) FROM i GROUP BY 2 UNION ALL SELECT 'severity', coalesce(severity, 'unclassified'), count(*) FROM i GROUP BY 2 UNION ALL SELECT 'boundary', coalesce(boundary, 'undetermined'), count(*) FROM i GROUP BY 2""",
    "issue_fold_by_fingerprint": "SELECT sha256('p|runtime||user {id} failed on shard ' || user_id % 7) AS fingerprint, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen, last(user_id ORDER BY ts, event_id) AS last_user FROM events WHERE event_type = 'error' GROUP BY 1",
    "issue_boundary": f"WITH {_BOUND} SELECT boundary, CAST(confidence AS DOUBLE) AS confidence, count(*) AS n, CAST(sum(CASE lower(split_part(o_orderpriority, '-', -1)) WHEN 'critical' THEN 300 WHEN 'high' THEN 200 WHEN 'medium' THEN 100 WHEN 'low' THEN 50 ELSE 100 END) AS BIGINT) AS priority FROM b GROUP BY 1, 2",
    "command_policy": """WITH c(i, command, decision) AS (VALUES (0, 'git status', 'allow'), (1, 'rm -fr /tmp', 'deny'), (2, 'git reset --hard', 'deny'), (3, 'pytest -q', 'allow'), (4, 'curl x', 'approval_required'), (5, ' npm run build', 'allow'), (6, 'format c:', 'deny'), (7, 'svn info', 'allow'),
      (8, 'RM -R x', 'deny'), (9, 'rmdir /s x', 'deny'), (10, 'git clean -fd', 'deny'), (11, 'diskpart', 'deny'), (12, 'cipher /w', 'deny'), (13, 'git log -3', 'allow'), (14, 'git diff', 'allow'), (15, 'python -m pytest t', 'allow'),
      (16, 'git clone u', 'allow'), (17, 'git push', 'approval_required'), (18, 'svn export u', 'allow'), (19, 'svn commit', 'approval_required'), (20, 'pnpm test', 'allow'), (21, 'npm publish', 'approval_required'), (22, 'Get-Content f', 'allow'), (23, 'tesseract ocr', 'allow'),
      (24, 'rgx y', 'approval_required'), (25, 'rg x', 'allow'), (26, 'rm file', 'approval_required'), (27, 'information', 'approval_required'), (28, 'git reset --soft', 'approval_required'), (29, 'sudo rm -r /', 'deny'), (30, 'echo git status', 'approval_required'), (31, 'npm run format', 'deny')),
      p AS (SELECT command, CASE WHEN p_size % 9 = 0 THEN 'file_change' ELSE 'command' END AS kind, CASE WHEN p_size % 9 = 0 THEN 'allow' ELSE decision END AS decision FROM part JOIN c ON p_partkey % 32 = i)
      SELECT command, kind, decision, count(*) AS n FROM p GROUP BY 1, 2, 3""",
    "audit_task_summary": "SELECT user_id, count(*) AS events, last(event_type ORDER BY ts, event_id) AS last_type, max(event_id) AS last_event FROM events GROUP BY 1",
    "audit_event_join": "SELECT event_id, user_id, event_type FROM events JOIN customer ON c_custkey = user_id WHERE c_mktsegment = 'BUILDING' AND event_id > 100 ORDER BY event_id LIMIT 500",
    "idempotent_admission": """WITH r AS (SELECT conv_id AS key, turn, attempt, role, text FROM conversations, (VALUES (0), (1)) a(attempt) WHERE attempt = 0 OR turn % 2 = 0)
      SELECT key, turn, attempt, CASE WHEN row_number() OVER w = 1 THEN 'admitted' WHEN role = first_value(role) OVER w AND text = first_value(text) OVER w THEN 'replay' ELSE 'conflict' END AS outcome FROM r WINDOW w AS (PARTITION BY key ORDER BY attempt, turn)""",
    "cancel_vs_complete": "SELECT l_orderkey, first(CASE WHEN l_returnflag = 'R' THEN 'cancelled' ELSE 'completed' END ORDER BY l_shipdate, l_returnflag DESC) AS decision FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1",
    "access_filtered_rows": "SELECT c_custkey, c_nationkey FROM customer WHERE (c_custkey % 3 = 0 AND c_nationkey = 7) OR (c_custkey % 3 = 1 AND c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'))",
    "learning_threshold": "SELECT user_id, CASE event_type WHEN 'error' THEN 'failure' ELSE 'success' END AS kind, count(*) AS n FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1, 2 HAVING (kind = 'success' AND n >= 3) OR (kind = 'failure' AND n >= 2)",
    "promotion_state": """WITH o AS (SELECT user_id, ts, event_id, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS ok FROM events), g AS (SELECT *, sum(ok) OVER w AS f, sum(1 - ok) OVER w AS s FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      r AS (SELECT user_id, max(fs) AS failures, max(ss) AS successes FROM (SELECT user_id, sum(1 - ok) OVER (PARTITION BY user_id, f ORDER BY ts, event_id) AS fs, sum(ok) OVER (PARTITION BY user_id, s ORDER BY ts, event_id) AS ss FROM g) GROUP BY 1)
      SELECT user_id, CAST(failures AS BIGINT) AS failures, CAST(successes AS BIGINT) AS successes, CASE WHEN failures >= 2 THEN 'rolled_back' WHEN successes >= 10 THEN 'promoted' WHEN successes >= 5 THEN 'canary' ELSE 'shadow' END AS state FROM r""",
    "gate_evaluation": "SELECT l_orderkey, bool_and(l_quantity > 5) AS passed, count(*) AS gates FROM lineitem GROUP BY 1",
}
