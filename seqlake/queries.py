"""The registered queries of the table engine, each beside the same relation in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlake.engine import Batch, Engine, ExternalWriter, write_external, write_image
from seqlake.functions.durable import shared_folder
from seqlake.functions.model import MAX_SEQ, PUT, in_bounds, size_of
from seqlake.operators import changes, compaction, visibility, writes
from seqlake.operators.ranges import with_cover
from seqlake.plans import planner
from seqlake.sources import fixtures as fx

T = fx.NOW
RULES = planner.TierRules(ratio=4, min_tables=4, byte_trigger=200_000, tombstone_ratio=0.5, max_levels=8)
RETAIN = 5000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Shared parts of the SQL.
M = f"""m AS (SELECT event_id + 1 AS seq, 'u' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS kind,
  CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value, CASE WHEN event_type = 'signup' THEN CAST(floor(epoch(ts)) AS BIGINT) + {fx.DEADLINE} ELSE 0 END AS expires_at,
  event_id + 1 - event_id % {fx.BATCH} AS batch_seq, CAST(floor(epoch(ts)) AS BIGINT) AS at_s FROM events)"""
RT = "rt AS (SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS start_key, 'u' || lpad(CAST(user_id + 5 AS VARCHAR), 8, '0') AS end_key, event_id + 1 AS seq FROM events WHERE event_id % 97 = 13)"
S = f"(SELECT max(seq) FROM m WHERE at_s <= {T})"
LAST = "(SELECT max(seq) FROM m)"
KEYS = "wanted AS (SELECT 'u' || lpad(CAST(range * 7 + 1 AS VARCHAR), 8, '0') AS key FROM range(40) UNION ALL SELECT 'u' || lpad(CAST(range * 7 + 1 AS VARCHAR), 8, '0') FROM range(3) UNION ALL SELECT 'x' || CAST(range AS VARCHAR) FROM range(5) UNION ALL SELECT '')"
FILES = "files AS (SELECT c_custkey AS num, CAST(floor(c_custkey / 400) AS INT) AS depth, 1000 + (c_custkey * 7919) % 5003 AS size, (c_custkey % 400) * 40 AS min_key, (c_custkey % 400) * 40 + (c_custkey * 7919) % 61 AS max_key, 10 + c_custkey % 90 AS entries, (c_custkey * 31) % (10 + c_custkey % 90) AS tombstones FROM customer)"
GROUPS = """marked AS (SELECT *, CASE WHEN min_key <= max(max_key) OVER (PARTITION BY depth ORDER BY min_key, num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM files),
  grouped AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY depth ORDER BY min_key, num) AS BIGINT) AS grp FROM marked)"""


def state_sql(seq: str, more: str = "TRUE", now: int = T) -> str:
    """Parts p (deciding versions) and vis (visible entries) at a sequence."""
    return f"""p AS (SELECT key, seq, kind, value, expires_at FROM m WHERE seq <= {seq} AND {more} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
  vis AS (SELECT key, value, expires_at, seq FROM p WHERE kind = 0 AND (expires_at = 0 OR expires_at > {now}) AND NOT EXISTS (SELECT 1 FROM rt WHERE rt.start_key <= p.key AND p.key < rt.end_key AND rt.seq <= {seq} AND rt.seq > p.seq))"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def last_seq(spark: SparkSession, d: str) -> int:
    return fx.mutations(spark, d).agg(F.max("seq").alias("s")).first()["s"]


def fresh_folder(spark: SparkSession) -> str:
    """A new folder that all executors can reach."""
    return f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"


def log_and_ranges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return fx.mutations(spark, d), fx.range_deletes(spark, d)


# Reading.


@query(f"WITH {M}, {RT}, {state_sql(LAST)} SELECT key, value, expires_at, seq FROM vis")
def latest_state(spark, d):
    return visibility.visible(*log_and_ranges(spark, d), MAX_SEQ, T)


@query(f"WITH {M}, {RT}, {state_sql(S)} SELECT key, value, expires_at FROM vis")
def snapshot_state(spark, d):
    return visibility.visible(*log_and_ranges(spark, d), fx.sequence_at(spark, d), T).drop("seq")


@query(f"WITH {M}, {RT}, {state_sql(LAST, "key >= 'u00000020' AND key < 'u00000300'")} SELECT key, value, expires_at, seq FROM vis")
def range_scan(spark, d):
    return visibility.visible(*log_and_ranges(spark, d), MAX_SEQ, T, "u00000020", "u00000300")


@query(f"WITH {M}, {RT}, {state_sql(LAST)} SELECT key, value FROM vis WHERE key < ''")
def range_scan_empty_end(spark, d):
    return visibility.visible(*log_and_ranges(spark, d), MAX_SEQ, T, None, "").select("key", "value")


@query(f"WITH {M}, {RT}, {state_sql(LAST)} SELECT key, value, expires_at FROM vis WHERE key = (SELECT max(key) FROM m)")
def point_get(spark, d):
    log, ranges = log_and_ranges(spark, d)
    key = log.agg(F.max("key").alias("k")).first()["k"]
    return visibility.visible(log.filter(F.col("key") == key), ranges.filter((F.col("start_key") <= key) & (F.col("end_key") > key)), MAX_SEQ, T).drop("seq")


@query(f"WITH {M}, {RT}, {KEYS}, {state_sql(LAST)} SELECT key, value, expires_at, seq FROM vis WHERE key IN (SELECT key FROM wanted WHERE key <> '')")
def get_many(spark, d):
    return visibility.get_many(*log_and_ranges(spark, d), fx.wanted_keys(spark), MAX_SEQ, T)


@query(f"WITH {M}, {RT}, {KEYS}, {state_sql(LAST)} SELECT w.key, vis.key IS NOT NULL AS present FROM (SELECT DISTINCT key FROM wanted WHERE key <> '') w LEFT JOIN vis ON w.key = vis.key")
def has_many(spark, d):
    return visibility.has_many(*log_and_ranges(spark, d), fx.wanted_keys(spark), MAX_SEQ, T)


@query(f"WITH {M}, {RT}, {state_sql(S)} SELECT key, seq FROM p WHERE kind = 1")
def tombstoned_keys(spark, d):
    return visibility.newest(fx.mutations(spark, d), fx.sequence_at(spark, d)).filter("kind = 1").select("key", "seq")


@query(f"WITH {M}, {RT}, {state_sql(S)} SELECT key, seq, expires_at FROM p WHERE kind = 0 AND expires_at <> 0 AND expires_at <= {T}")
def expired_keys(spark, d):
    return visibility.newest(fx.mutations(spark, d), fx.sequence_at(spark, d)).filter((F.col("kind") == PUT) & (F.col("expires_at") != 0) & (F.col("expires_at") <= T)).select("key", "seq", "expires_at")


@query(f"WITH {M}, {RT}, {state_sql(S)} SELECT p.key, p.seq, max(rt.seq) AS cover FROM p JOIN rt ON rt.start_key <= p.key AND p.key < rt.end_key AND rt.seq <= {S} AND rt.seq > p.seq GROUP BY p.key, p.seq")
def range_deleted_keys(spark, d):
    s = fx.sequence_at(spark, d)
    log, ranges = log_and_ranges(spark, d)
    return with_cover(visibility.newest(log, s), ranges, s).filter("cover > seq").select("key", "seq", "cover")


@query(f"WITH {M}, {KEYS} SELECT key, seq, kind, value, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS version FROM m WHERE key IN (SELECT key FROM wanted WHERE key <> '')")
def key_history(spark, d):
    return visibility.history(fx.mutations(spark, d), fx.wanted_keys(spark))


@query(f"""WITH {M}, {RT}, {state_sql(S)} SELECT k.key, CASE WHEN p.key IS NULL THEN 'not_yet' WHEN p.kind = 1 THEN 'deleted'
  WHEN EXISTS (SELECT 1 FROM rt WHERE rt.start_key <= p.key AND p.key < rt.end_key AND rt.seq <= {S} AND rt.seq > p.seq) THEN 'range_deleted'
  WHEN p.expires_at <> 0 AND p.expires_at <= {T} THEN 'expired' ELSE 'live' END AS state FROM (SELECT DISTINCT key FROM m) k LEFT JOIN p ON k.key = p.key""")
def state_classification(spark, d):
    return visibility.classified(*log_and_ranges(spark, d), fx.sequence_at(spark, d), T)


# Writing.

OPS = "ops AS (SELECT (seq - 1) // 10 AS batch, seq AS ord, kind, CASE WHEN seq % 97 = 0 THEN '' ELSE key END AS key, value, CASE WHEN seq % 89 = 0 THEN -1 ELSE expires_at END AS expires_at FROM m)"


@query(f"""WITH {M}, {OPS}, bad AS (SELECT batch, ord, CASE WHEN key = '' THEN 'empty_key' WHEN kind = 0 AND expires_at < 0 THEN 'invalid_ttl' END AS error FROM ops)
  SELECT batch, arg_min(error, ord) FILTER (WHERE error IS NOT NULL) AS error FROM bad GROUP BY batch""")
def batch_validation(spark, d):
    seq = F.col("seq")
    ops = fx.mutations(spark, d).select(F.floor((seq - 1) / 10).cast("bigint").alias("batch"), seq.alias("ord"), "kind", F.when(seq % 97 == 0, "").otherwise(F.col("key")).alias("key"), "value", F.when(seq % 89 == 0, -1).otherwise(F.col("expires_at")).alias("expires_at"))
    return writes.first_errors(ops)


@query(f"WITH {M} SELECT batch_seq, ord, batch_seq + row_number() OVER (PARTITION BY batch_seq ORDER BY ord) - 1 AS seq FROM (SELECT batch_seq, seq * 7 AS ord FROM m)")
def sequence_assignment(spark, d):
    ops = fx.mutations(spark, d).select("batch_seq", (F.col("seq") * 7).alias("ord"))
    return writes.sequences_in_batches(ops)


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) + 1000 AS seq FROM lineitem")
def bulk_sequences(spark, d):
    rows = fx.table(spark, d, "lineitem")
    return writes.with_sequences(rows, 1000, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "seq")


@query(f"WITH {M} SELECT batch_seq, max(seq) AS last_seq, CAST(count(*) FILTER (WHERE seq <= {S}) AS BIGINT) AS at_snapshot, max(seq) <= {S} AS visible FROM m GROUP BY batch_seq")
def batch_commit_watermark(spark, d):
    s = fx.sequence_at(spark, d)
    return fx.mutations(spark, d).groupBy("batch_seq").agg(F.max("seq").alias("last_seq"), F.count(F.when(F.col("seq") <= s, 1)).alias("at_snapshot"), (F.max("seq") <= s).alias("visible"))


OM = "om AS (SELECT o_orderkey AS seq, o_custkey AS key, o_orderstatus AS value FROM orders)"
DEDUP = f"{OM}, kept AS (SELECT seq, key, value FROM (SELECT *, lag(value) OVER (PARTITION BY key ORDER BY seq) AS before, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM om) WHERE n = 1 OR before IS DISTINCT FROM value)"


@query(f"WITH {DEDUP} SELECT seq, key, value FROM kept")
def dedup_orders(spark, d):
    return writes.changed_puts(fx.order_puts(spark, d))


@query(f"WITH {DEDUP} SELECT CAST(sum(8 + octet_length(encode(value))) AS BIGINT) AS bytes, count(*) AS puts FROM kept")
def user_bytes(spark, d):
    return writes.changed_puts(fx.order_puts(spark, d)).agg((F.sum(8 + size_of(F.col("value")))).cast("bigint").alias("bytes"), F.count("*").alias("puts"))


# Changes.


@query(f"WITH {M} SELECT seq, key, kind, value, expires_at, batch_seq FROM m WHERE seq > {S} - 205 AND seq <= {S}")
def updates_since(spark, d):
    s = fx.sequence_at(spark, d)
    return changes.updates_since(fx.mutations(spark, d).drop("at"), s - 205, s)


@query(f"WITH {M} SELECT batch_seq, count(*) AS ops, min(seq) AS first_seq, max(seq) AS last_seq FROM m WHERE seq > {S} - 205 AND seq <= {S} GROUP BY batch_seq")
def updates_batches(spark, d):
    s = fx.sequence_at(spark, d)
    return changes.batches_of(changes.updates_since(fx.mutations(spark, d), s - 205, s))


HOLED = f"{M}, h AS (SELECT seq FROM m WHERE seq % 613 NOT IN (0, 1, 2) AND seq <= {LAST} - 10)"


@query(f"WITH {HOLED}, x AS (SELECT seq FROM h UNION ALL SELECT 0 UNION ALL SELECT {LAST} + 1), g AS (SELECT seq, lag(seq) OVER (ORDER BY seq) AS before FROM x) SELECT before + 1 AS first_missing, seq - 1 AS last_missing FROM g WHERE seq > before + 1")
def gap_report(spark, d):
    last = last_seq(spark, d)
    log = fx.mutations(spark, d).filter((F.col("seq") % 613 > 2) & (F.col("seq") <= last - 10))
    return changes.gaps(log, 0, last)


@query(f"WITH {M} SELECT seq, key FROM m WHERE seq < coalesce((SELECT min(seq) FROM m WHERE seq % 1009 = 0), 1e18)")
def recovery_prefix(spark, d):
    log = fx.mutations(spark, d)
    return changes.recovered(log, log.filter("seq % 1009 = 0").select("seq")).select("seq", "key")


@query(f"WITH {M} SELECT seq, key FROM m WHERE seq >= 501 AND seq < coalesce((SELECT min(seq) FROM m WHERE seq % 997 = 0 AND seq >= 501), 1e18)")
def recovery_boundary(spark, d):
    log = fx.mutations(spark, d)
    return changes.recovered(log, log.filter("seq % 997 = 0").select("seq"), 501).select("seq", "key")


SEGS = f"{M}, segs AS (SELECT (seq - 1) // 500 AS num, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0)) AS BIGINT) AS bytes, (SELECT max(at_s) FROM m) - max(at_s) AS age FROM m GROUP BY 1)"


@query(f"""WITH {SEGS}, c AS (SELECT *, row_number() OVER (ORDER BY num DESC) = 1 OR age <= 200000 OR coalesce(sum(bytes) OVER (ORDER BY num DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 60000 AS covered FROM segs)
  SELECT num, first_seq, last_seq, bytes, age, bool_or(covered) OVER (ORDER BY num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kept FROM c""")
def retention_reap(spark, d):
    log = fx.mutations(spark, d)
    end = log.agg(F.max("at").alias("at")).first()["at"]
    segments = log.groupBy(F.floor((F.col("seq") - 1) / 500).cast("bigint").alias("num")).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum(size_of(F.col("key")) + size_of(F.col("value"))).cast("bigint").alias("bytes"), (F.lit(end) - F.max("at")).alias("age"))
    return changes.kept_segments(segments, 200_000, 60_000)


# Compaction.


def compact_sql(reclaim: str, keep: str = "TRUE", through: int = 0, retain: str = str(RETAIN)) -> str:
    seen = f"seq <= {through}" if through else "TRUE"
    return f"""WITH {M}, {RT}, {FILES}, r AS (SELECT {retain} AS r), e AS (SELECT *, kind = 1 OR (expires_at <> 0 AND expires_at <= {T}) OR ({seen} AND NOT coalesce({keep}, FALSE)) AS dead, seq <= (SELECT r FROM r) AS old FROM m),
  f AS (SELECT * FROM e QUALIFY NOT old OR row_number() OVER (PARTITION BY key, old ORDER BY seq DESC) = 1),
  c AS (SELECT f.*, coalesce((SELECT max(rt.seq) FROM rt WHERE rt.start_key <= f.key AND f.key < rt.end_key AND rt.seq <= (SELECT r FROM r)), 0) AS cover, {reclaim} AS reclaim FROM f)
  SELECT seq, key, CASE WHEN dead THEN 1 ELSE kind END AS kind, CASE WHEN dead THEN NULL ELSE value END AS value, CASE WHEN dead THEN 0 ELSE expires_at END AS expires_at FROM c WHERE NOT (old AND reclaim AND (cover > seq OR dead))"""


@query(f"WITH {M}, {RT} SELECT start_key, end_key, seq, seq > {RETAIN} AS at_bottom FROM rt")
def carried_ranges(spark, d):
    ranges = fx.range_deletes(spark, d)
    bottom = compaction.kept_ranges(ranges, RETAIN, True).select("*", F.lit(True).alias("at_bottom"))
    return compaction.kept_ranges(ranges, RETAIN, False).join(bottom, ["start_key", "end_key", "seq"], "left").withColumn("at_bottom", F.coalesce("at_bottom", F.lit(False)))


@query(compact_sql("FALSE"))
def compact_retain(spark, d):
    return compaction.compacted(*log_and_ranges(spark, d), RETAIN, T)


@query(compact_sql("TRUE"))
def compact_bottom(spark, d):
    return compaction.compacted(*log_and_ranges(spark, d), RETAIN, T, True)


@query(compact_sql("TRUE", "(value LIKE '%1%')", 4000))
def compact_filter(spark, d):
    return compaction.compacted(*log_and_ranges(spark, d), RETAIN, T, True, F.col("value").like("%1%"), 4000)


LEFT_BEHIND = "(SELECT 'u' || lpad(CAST(min_key AS VARCHAR), 8, '0') AS lo, 'u' || lpad(CAST(max_key AS VARCHAR), 8, '0') AS hi FROM files WHERE depth = 0 AND num % 3 = 0)"


@query(compact_sql(f"NOT EXISTS (SELECT 1 FROM {LEFT_BEHIND} b WHERE b.lo <= f.key AND f.key <= b.hi)"))
def compact_partial_reclaim(spark, d):
    log, ranges = log_and_ranges(spark, d)
    left = fx.files(spark, d).filter("depth = 0 AND num % 3 = 0").select(fx.key_of(F.col("min_key")).alias("min_key"), fx.key_of(F.col("max_key")).alias("max_key"))
    return compaction.compacted(compaction.outside(log, left), ranges, RETAIN, T, F.col("reclaim"))


@query(f"WITH {M} SELECT DISTINCT key, seq, kind, value FROM m")
def replay_dedup(spark, d):
    log = fx.mutations(spark, d)
    return compaction.without_replays(log.unionByName(log.filter("seq % 3 = 0"))).select("key", "seq", "kind", "value")


@query(f"WITH {M}, x AS (SELECT key, seq, kind, value, expires_at FROM m UNION ALL SELECT key, seq, kind, value || '!', expires_at FROM m WHERE seq % 50 = 0 AND kind = 0 UNION ALL SELECT key, seq, 1, NULL, 0 FROM m WHERE seq % 70 = 0), y AS (SELECT DISTINCT * FROM x) SELECT key, seq, count(*) AS different FROM y GROUP BY key, seq HAVING count(*) > 1 AND NOT (count(*) FILTER (WHERE kind = 0) = 1 AND bool_or(kind = 0 AND expires_at <> 0))")
def conflicts(spark, d):
    log = fx.mutations(spark, d).select("key", "seq", "kind", "value", "expires_at")
    other = log.filter("seq % 50 = 0 AND kind = 0").withColumn("value", F.concat("value", F.lit("!")))
    gone = log.filter("seq % 70 = 0").select("key", "seq", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(0).cast("bigint").alias("expires_at"))
    return compaction.conflicts(log.union(other).union(gone))


PINS = f"(SELECT min(s) FROM (SELECT {S} AS s UNION ALL SELECT {S} // 2))"


@query(compact_sql("FALSE", retain=PINS))
def pinned_retain(spark, d):
    s = fx.sequence_at(spark, d)
    return compaction.compacted(*log_and_ranges(spark, d), min(s, s // 2), T)


# Files.


@query(f"WITH {FILES}, {GROUPS} SELECT num, depth, grp FROM grouped")
def overlap_groups(spark, d):
    return planner.grouped(fx.files(spark, d)).select("num", "depth", "grp")


@query(f"WITH {FILES}, {GROUPS} SELECT depth, grp, count(*) AS tables FROM grouped GROUP BY depth, grp QUALIFY row_number() OVER (PARTITION BY depth ORDER BY count(*) DESC, min(min_key)) = 1")
def largest_group(spark, d):
    return planner.largest_groups(fx.files(spark, d))


@query(f"WITH {FILES}, x AS (SELECT *, row_number() OVER w AS n, coalesce(sum(size) OVER (PARTITION BY depth ORDER BY min_key, num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM files WINDOW w AS (PARTITION BY depth ORDER BY min_key, num)) SELECT depth, num, CAST(before + size AS BIGINT) AS total FROM x WHERE n <= 2 OR before < 100000")
def byte_cap_prefix(spark, d):
    return planner.capped_prefix(fx.files(spark, d), 100_000).select("depth", "num", "total")


READY = f"""{FILES}, {GROUPS}, g AS (SELECT depth, max(n) AS largest FROM (SELECT depth, grp, count(*) AS n FROM grouped GROUP BY depth, grp) GROUP BY depth),
  t AS (SELECT depth, count(*) AS tables, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(entries) AS BIGINT) AS entries, CAST(sum(tombstones) AS BIGINT) AS tombstones FROM files GROUP BY depth),
  ready AS (SELECT t.*, largest AS largest_overlap, NOT (depth > 0 AND tables < 4) AND ((depth < 7 AND (depth = 0 OR tables >= 8 OR largest >= 2) AND (tables >= 4 OR (tables >= 2 AND bytes >= 200000))) OR (tables >= 2 AND entries > 0 AND tombstones >= 0.5 * entries)) AS ready FROM t JOIN g USING (depth))"""


@query(f"WITH {READY} SELECT depth, tables, bytes, entries, tombstones, largest_overlap, ready, depth = (SELECT min(depth) FROM ready WHERE ready) AS chosen FROM ready")
def pick_tier(spark, d):
    tiers = planner.tier_readiness(fx.files(spark, d), RULES)
    first = tiers.filter("ready").agg(F.min("depth").alias("first"))
    return tiers.crossJoin(F.broadcast(first)).withColumn("chosen", F.col("depth") == F.col("first")).drop("first")  # one row


PROBES = "(SELECT range * 97 AS key FROM range(160))"


@query(f"WITH {FILES} SELECT k.key, num FROM {PROBES} k JOIN files ON min_key <= k.key AND k.key <= max_key")
def file_candidates(spark, d):
    return planner.candidates(spark.range(160).select((F.col("id") * 97).alias("key")), fx.files(spark, d))


@query("SELECT CAST(range AS INT) AS depth, CAST(least(2097152 * (2 ** range), 134217728) AS BIGINT) AS target FROM range(10)")
def size_curve(spark, d):
    targets = planner.size_targets(2 << 20, 2, 128 << 20, list(range(10)))
    return spark.createDataFrame(list(targets.items()), "depth int, target bigint")


@query("SELECT s_suppkey AS num FROM supplier WHERE s_suppkey % 3 <> 0")
def manifest_fold(spark, d):
    num = F.col("s_suppkey").alias("num")
    added = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("edit"), F.lit("add").alias("op"), num)
    gone = fx.table(spark, d, "supplier").filter("s_suppkey % 3 = 0").select((F.col("s_suppkey") + 1_000_000_000).alias("edit"), F.lit("delete").alias("op"), num)
    return planner.live(added.union(gone))


@query(f"WITH {FILES} SELECT num, depth, size, min_key, max_key FROM files WHERE num = (SELECT max(num) FROM files)")
def newest_file(spark, d):
    return planner.newest_file(fx.files(spark, d)).select("num", "depth", "size", "min_key", "max_key")


@query(f"WITH {FILES} SELECT depth, count(*) AS tables, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(entries) AS BIGINT) AS entries, CAST(sum(tombstones) AS BIGINT) AS tombstones FROM files GROUP BY depth")
def depth_histogram(spark, d):
    return planner.depth_histogram(fx.files(spark, d))


@query(f"WITH {FILES} SELECT k.key, count(num) AS files FROM {PROBES} k LEFT JOIN files ON min_key <= k.key AND k.key <= max_key GROUP BY k.key")
def read_fanout(spark, d):
    keys = spark.range(160).select((F.col("id") * 97).alias("key"))
    met = planner.candidates(keys, fx.files(spark, d)).groupBy("key").agg(F.count("*").alias("files"))
    return keys.join(met, "key", "left").select("key", F.coalesce("files", F.lit(0)).alias("files"))


# Ingest, images, blobs, merges.


@query(f"WITH {M}, {RT}, {state_sql(LAST)}, i AS (SELECT 'u' || lpad(CAST(n_nationkey AS VARCHAR), 8, '0') AS key, n_name AS value FROM nation) SELECT key, value, {LAST} + 1 AS seq FROM i UNION ALL SELECT key, value, seq FROM vis WHERE key NOT IN (SELECT key FROM i)")
def ingest_newest_wins(spark, d):
    log, ranges = log_and_ranges(spark, d)
    s = last_seq(spark, d) + 1
    new = fx.table(spark, d, "nation").select(fx.key_of(F.col("n_nationkey")).alias("key"), F.col("n_name").alias("value"), F.lit(s).cast("bigint").alias("seq"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("expires_at"))
    return visibility.visible(log.select(*new.columns).unionByName(new), ranges, s, T).select("key", "value", "seq")


@query(f"WITH {M}, {RT}, {state_sql(S)} SELECT key, value, expires_at FROM vis")
def image_export(spark, d):
    path = fresh_folder(spark)
    write_image(visibility.visible(*log_and_ranges(spark, d), fx.sequence_at(spark, d), T), path, parts=4)
    return spark.read.parquet(path).select("key", "value", "expires_at")


FOLLOWER = f"""image AS (SELECT key, value, expires_at, {S} AS seq, 0 AS kind FROM vis), tail AS (SELECT key, value, expires_at, seq, kind FROM m WHERE seq > {S}),
  fboth AS (SELECT * FROM image UNION ALL SELECT * FROM tail), fp AS (SELECT * FROM fboth QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
  follower AS (SELECT key, value, expires_at FROM fp WHERE kind = 0 AND (expires_at = 0 OR expires_at > {T}) AND NOT EXISTS (SELECT 1 FROM rt WHERE rt.start_key <= fp.key AND fp.key < rt.end_key AND rt.seq > {S} AND rt.seq > fp.seq))"""
LEADER = f"""lp AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
  leader AS (SELECT key, value, expires_at FROM lp WHERE kind = 0 AND (expires_at = 0 OR expires_at > {T}) AND NOT EXISTS (SELECT 1 FROM rt WHERE rt.start_key <= lp.key AND lp.key < rt.end_key AND rt.seq > lp.seq))"""


@query(f"WITH {M}, {RT}, {state_sql(S)}, {FOLLOWER}, {LEADER} SELECT (SELECT count(*) FROM follower) AS followed, (SELECT count(*) FROM (SELECT * FROM follower EXCEPT ALL SELECT * FROM leader)) + (SELECT count(*) FROM (SELECT * FROM leader EXCEPT ALL SELECT * FROM follower)) AS mismatches")
def image_plus_tail(spark, d):
    log, ranges = log_and_ranges(spark, d)
    s, last = fx.sequence_at(spark, d), last_seq(spark, d)
    image = visibility.visible(log, ranges, s, T).select("key", "value", "expires_at", F.lit(s).cast("bigint").alias("seq"), F.lit(0).alias("kind"))
    tail = changes.updates_since(log, s, last).select(*image.columns)
    follower = visibility.visible(image.unionByName(tail), ranges.filter(F.col("seq") > s), last, T)
    leader = visibility.visible(log, ranges, last, T)
    a, b = follower.select("key", "value", "expires_at"), leader.select("key", "value", "expires_at")
    wrong = a.exceptAll(b).union(b.exceptAll(a)).agg(F.count("*").alias("mismatches"))
    return a.agg(F.count("*").alias("followed")).crossJoin(wrong)  # one row each


@query("SELECT doc_id, bytes, bytes >= 1024 AS blob, CASE WHEN bytes >= 1024 THEN bucket END AS file, CASE WHEN bytes >= 1024 THEN CAST(sum(CASE WHEN bytes >= 1024 THEN bytes ELSE 0 END) OVER (PARTITION BY bucket ORDER BY doc_id) AS BIGINT) - bytes END AS off FROM (SELECT doc_id, octet_length(encode(text)) AS bytes, doc_id // 256 AS bucket FROM documents)")
def blob_split(spark, d):
    rows = fx.table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"), F.floor(F.col("doc_id") / 256).cast("bigint").alias("bucket"))
    return planner.blob_places(rows, 1024, "bucket", "doc_id").drop("bucket")


@query(f"WITH {M} SELECT key, seq, kind, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS place FROM m")
def k_way_merge(spark, d):
    log = fx.mutations(spark, d)
    parts = [log.filter(F.col("seq") % 3 == k) for k in range(3)]
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))
    return visibility.merged(*parts).select("key", "seq", "kind", place.cast("bigint").alias("place"))


@query(f"WITH {M}, {RT}, {state_sql(LAST)} SELECT key, value, expires_at, seq FROM vis")
def stream_tail_state(spark, d):
    from seqlake.streaming.tail import follow

    log, ranges = log_and_ranges(spark, d)
    folder = fresh_folder(spark)
    log.drop("at").repartition(4).write.mode("overwrite").parquet(f"{folder}/changes")
    follow(spark, f"{folder}/changes", f"{folder}/applied", f"{folder}/progress")
    return visibility.visible(spark.read.parquet(f"{folder}/applied"), ranges, last_seq(spark, d), T)


@query(f"WITH {M} SELECT seq, key, value FROM m WHERE key >= 'u00000020' AND key < 'u00000300' AND kind = 0")
def bounded_versions(spark, d):
    return fx.mutations(spark, d).filter(in_bounds(F.col("key"), "u00000020", "u00000300") & (F.col("kind") == PUT)).select("seq", "key", "value")


# Whole tables: written, closed, reopened, merged, and read again. Keys and values are bytes there.

PLAIN = f"v AS (SELECT key, value, expires_at, seq FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE kind = 0 AND (expires_at = 0 OR expires_at > {T}))"


def operations(spark: SparkSession, d: str) -> DataFrame:
    """The mutations as a batch; their sequences come out as they are in the log."""
    return fx.mutations(spark, d).select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "kind", "expires_at", F.col("seq").alias("ord"))


def filled(spark: SparkSession, d: str, parts: int = 1, **options) -> Engine:
    """A table with the mutations, written as so many batches one after another."""
    t = Engine.open(spark, fresh_folder(spark), clock=lambda: T, **options)
    ops, last = operations(spark, d), last_seq(spark, d)
    for k in range(parts):
        t.write_df(ops.filter((F.col("ord") > last * k // parts) & (F.col("ord") <= last * (k + 1) // parts)), ["ord"], 2)
    return t


def reopened(t: Engine, **options) -> Engine:
    t.close()
    return Engine.open(t.spark, t.path, clock=t.clock, **options)


def text(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"key": F.col("key").cast("string"), "value": F.col("value").cast("string")})


@query(f"WITH {M}, {PLAIN} SELECT key, value, expires_at, seq FROM v WHERE NOT (key >= 'u00000010' AND key < 'u00000030') UNION ALL SELECT 'u00000015', 'again', 0, {LAST} + 2")
def engine_reopen(spark, d):
    t = filled(spark, d)
    t.write(Batch().delete_range(b"u00000010", b"u00000030").put(b"u00000015", b"again"))
    return text(reopened(t, read_only=True).scan())


@query(f"WITH {M}, {PLAIN} SELECT key, value, expires_at, seq FROM v")
def engine_compacted(spark, d):
    t = filled(spark, d, 4, tier_ratio=2, min_compaction_tables=2)
    while t.maintain():
        pass
    t.compact_range()
    return text(reopened(t).scan())


@query(f"WITH {M}, {PLAIN} SELECT key, value, expires_at FROM v WHERE key >= 'u00000020' AND key < 'u00000300'")
def engine_range_scan(spark, d):
    t = filled(spark, d, 2)
    with t.snapshot() as s:
        t.delete_range(b"a", b"z")
        return text(s.scan(b"u00000020", b"u00000300")).drop("seq")


@query(f"WITH {M}, {PLAIN}, {KEYS} SELECT key, value, expires_at FROM v WHERE key IN (SELECT key FROM wanted)")
def engine_get_many(spark, d):
    return text(filled(spark, d, 2).get_many(fx.wanted_keys(spark).select(F.col("key").cast("binary").alias("key")))).drop("seq")


@query(f"WITH {M} SELECT seq, key, kind, value, expires_at FROM m WHERE seq > {LAST} - 700")
def engine_changes(spark, d):
    t = reopened(filled(spark, d, 3))
    return text(t.updates_since(t.latest_seq() - 700)).select("seq", "key", "kind", "value", "expires_at")


@query(f"WITH {M}, {PLAIN}, i AS (SELECT 'u' || lpad(CAST(n_nationkey AS VARCHAR), 8, '0') AS key, n_name AS value FROM nation UNION ALL SELECT 'zz', 'last') SELECT key, value, {LAST} + 1 AS seq FROM i UNION ALL SELECT key, value, seq FROM v WHERE key NOT IN (SELECT key FROM i)")
def engine_ingest(spark, d):
    t, path = filled(spark, d), fresh_folder(spark)
    new = fx.table(spark, d, "nation").select(fx.key_of(F.col("n_nationkey")).cast("binary").alias("key"), F.col("n_name").cast("binary").alias("value"))
    write_external(new.union(spark.createDataFrame([(bytearray(b"zz"), bytearray(b"last"))], "key binary, value binary")), path)
    t.ingest(path)
    return text(t.scan()).select("key", "value", "seq")


@query("SELECT printf('r%03d', r_regionkey) AS key, r_name AS value, CAST(CASE WHEN r_regionkey % 2 = 0 THEN 0 ELSE 2000000000 END AS BIGINT) AS expires_at FROM region WHERE r_regionkey <> 3")
def engine_external_writer(spark, d):
    t, path = Engine.open(spark, fresh_folder(spark), clock=lambda: T), fresh_folder(spark)
    t.put(b"r003", b"old")
    w = ExternalWriter(spark, path)
    for r in fx.table(spark, d, "region").orderBy("r_regionkey").collect():  # five rows
        k = b"r%03d" % r["r_regionkey"]
        if r["r_regionkey"] == 3:
            w.delete(k)
        else:
            w.put(k, r["r_name"].encode(), 0 if r["r_regionkey"] % 2 == 0 else 2_000_000_000)
    w.finish()
    t.ingest(path)
    return text(t.scan()).drop("seq")


@query(f"WITH {M}, {PLAIN} SELECT key, value, expires_at FROM v WHERE key <> 'u00000002' UNION ALL SELECT 'u00000002', 'tail', 0")
def engine_image(spark, d):
    leader, follower, path = filled(spark, d, 2), Engine.open(spark, fresh_folder(spark), clock=lambda: T), fresh_folder(spark)
    with leader.snapshot() as s:
        seq = s.write_to(path)
    leader.put(b"u00000002", b"tail")
    follower.ingest(path)
    follower.write_df(leader.updates_since(seq), ["seq"], 1)
    return text(follower.scan()).drop("seq")


@query("SELECT CAST(doc_id AS VARCHAR) AS key, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, md5(text) AS digest FROM documents WHERE doc_id <> 1")
def engine_blobs(spark, d):
    t = Engine.open(spark, fresh_folder(spark), clock=lambda: T, value_threshold=1024, blob_file_size=1 << 20)
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").cast("string").cast("binary").alias("key"), F.encode("text", "UTF-8").alias("value"), "doc_id")
    t.write_df(docs, ["doc_id"], 2)
    t.delete(b"1")
    t.compact_range()
    return reopened(t, value_threshold=1024).scan().select(F.col("key").cast("string").alias("key"), F.octet_length("value").cast("bigint").alias("bytes"), F.md5("value").alias("digest"))


@query(f"WITH {M} SELECT TRUE AS ok, count(*) AS entries FROM m")
def engine_verify(spark, d):
    t = filled(spark, d, 2)
    return t.verify().join(t.tables(), "num").groupBy("ok").agg(F.sum("entries").alias("entries"))


@query(f"WITH {M} SELECT {LAST} AS last_seq, CAST(3 AS BIGINT) AS batches, count(*) AS ops, count(*) AS entries, count(*) FILTER (WHERE kind = 1) AS tombstones, CAST(sum(octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0)) AS BIGINT) AS user_bytes FROM m")
def engine_stats(spark, d):
    return filled(spark, d, 3).stats().select("last_seq", "batches", "ops", "entries", "tombstones", "user_bytes")


@query(f"WITH {DEDUP} SELECT row_number() OVER (ORDER BY seq) AS seq, CAST(key AS VARCHAR) AS key, value FROM kept")
def engine_deduplication(spark, d):
    t = Engine.open(spark, fresh_folder(spark), clock=lambda: T, deduplication=True)
    puts = fx.order_puts(spark, d).select(F.col("seq").alias("ord"), F.col("key").cast("string").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    half = fx.table(spark, d, "orders").agg(F.max("o_orderkey").alias("m")).first()["m"] // 2
    t.write_df(puts.filter(F.col("ord") <= half), ["ord"], 2)
    t.write_df(puts.filter(F.col("ord") > half), ["ord"], 2)
    return text(t.updates_since(0)).select("seq", "key", "value")


@query(f"WITH {M}, {PLAIN} SELECT key, value, expires_at, seq FROM v WHERE value LIKE '%1%'")
def engine_filter(spark, d):
    t = filled(spark, d, 2, compaction_filter=lambda key, value, expires_at: value.cast("string").like("%1%"))
    t.compact_range()
    return text(t.scan())


@query(f"WITH {M}, {PLAIN} SELECT key, value, expires_at, seq FROM v WHERE key >= 'u00000020'")
def engine_pinned(spark, d):
    t = filled(spark, d, 2)
    s = t.snapshot()
    t.delete_range(b"a", b"z")
    t.compact_range()
    t.vacuum()
    return text(s.scan(b"u00000020"))  # the snapshot keeps its versions and its files


@query("SELECT CAST(n_nationkey AS BIGINT) + 1 AS seq, CAST(n_nationkey AS BIGINT) + 1 AS batch_seq, n_name AS value FROM nation")
def engine_group(spark, d):
    t = Engine.open(spark, fresh_folder(spark), clock=lambda: T)
    with t.group():
        for r in fx.table(spark, d, "nation").orderBy("n_nationkey").collect():  # 25 rows
            t.put(b"%02d" % r["n_nationkey"], r["n_name"].encode())
    return text(t.updates_since(0)).select("seq", "batch_seq", "value")


@query(f"WITH {M} SELECT CAST(1 AS INT) AS depth, count(*) AS entries, count(*) FILTER (WHERE kind = 1) AS tombstones FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE kind = 0 AND (expires_at = 0 OR expires_at > {T})")
def engine_levels(spark, d):
    t = filled(spark, d, 3)
    t.compact_range()
    return t.levels().select("depth", "entries", "tombstones")
