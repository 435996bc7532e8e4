"""Registered queries that run as streams: the bucketed ledger, the states of a crawl, a paged listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawmill.operators import ledger as G
from lawmill.plans.catalog import _events, _t, query
from lawmill.sources import listing, readers, scratch
from lawmill.streaming import crawl_states as S
from lawmill.streaming.ledger_table import LedgerTable

#: Files that a table is dealt into, each a micro-batch.
BATCHES = 4


def _in_turns(rows: DataFrame, order: str, name: str) -> DataFrame:
    """All rows as a stream of BATCHES files, written one after the other by ranges of order."""
    spark, path = rows.sparkSession, scratch.folder(rows.sparkSession, name)
    low, high = rows.agg(F.min(order), F.max(order)).first()
    part = F.floor((F.col(order) - F.lit(low or 0)) * BATCHES / F.lit((high or 0) - (low or 0) + 1))
    for k in range(BATCHES):
        rows.where(part == k).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("WITH r AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) SELECT user_id, event_type, event_id, value FROM r WHERE r = 1")
def ledger_buckets(spark, sf_dir):
    """SNK-5, STR-3: events in micro-batches, upserted into a ledger in hash buckets"""
    stream = _in_turns(_events(spark, sf_dir), "event_id", "ledger-in")
    path = scratch.folder(spark, "ledger")
    table = LedgerTable(spark, path, ["user_id", "event_type"], "event_id", 16)
    run = stream.writeStream.foreachBatch(table.apply).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return table.read().select("user_id", "event_type", "event_id", "value")


_ADDRESS = "concat_ws('/', user_id, event_id div 500)"
_OUTCOME = "CASE event_type WHEN 'purchase' THEN 'downloaded' WHEN 'signup' THEN 'skipped_scanned' WHEN 'error' THEN 'failed' END"


@query(f"""WITH e AS (SELECT event_id, user_id || '/' || (event_id // 500) AS key, {_OUTCOME} AS status FROM events),
s AS (SELECT key, min(event_id) FILTER (WHERE status IN ('downloaded', 'skipped_scanned')) AS settled FROM e GROUP BY key)
SELECT key, coalesce(any_value(e.status) FILTER (WHERE event_id = settled), CASE WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'failed' ELSE 'pending' END) AS status,
  (count(*) FILTER (WHERE status = 'failed' AND event_id < coalesce(settled, 9000000000000000)))::INT AS attempts FROM e JOIN s USING (key) GROUP BY key""")
def crawl_states(spark, sf_dir):
    """STR-2, STR-5, STR-7: events as sightings and outcomes of addresses, in micro-batches over value state with retry timers"""
    rows = _t(spark, sf_dir, "events").select(F.expr(_ADDRESS).alias("key"), F.col("event_id").alias("seq"), F.expr(_OUTCOME).alias("status"), F.col("ts").cast("timestamp").alias("time"))
    stream = S.crawl_states(_in_turns(rows, "seq", "crawl-in"))
    path = scratch.folder(spark, "crawl")
    with S.keyed_state(spark):
        run = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    states = spark.read.schema(S.OUT).parquet(path).where("kind = 'state'")
    return G.latest(states.select("key", "status", "attempts", "seq"), ["key"], "seq").select("key", "status", "attempts")


@query("SELECT event_type AS court_value, (event_id // 64 + 1)::INT AS page, 'https://h/' || user_id AS url FROM events WHERE event_type <> 'view' GROUP BY ALL")
def listing_stream(spark, sf_dir):
    """SRC-15, STR-1, STR-4, FLT-9, SRT-10: a site of pages by group; offsets on the driver, pages fetched on the executors"""
    root = scratch.folder(spark, "site")
    page = (F.floor(F.col("event_id") / 64) + 1).alias("page")
    links = F.array_sort(F.collect_set(F.concat(F.lit("https://h/"), F.col("user_id").cast("string"))))
    pages = _t(spark, sf_dir, "events").groupBy("event_type", page).agg(links.alias("links"))
    k = F.floor((F.col("page") - 1) / listing.FolderSite.PAGES).cast("string")
    some = pages.groupBy("event_type", k.alias("k")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("page").cast("string"), "links")))).alias("content"))
    files = some.select(F.concat("event_type", F.lit("/"), "k", F.lit(".json")).alias("name"), F.col("content").cast("binary").alias("content"))
    root = root if "://" in root else f"file://{root.removeprefix('file:')}"
    readers.write_files(files, root, "name", "content").count()
    groups = [r[0] for r in _t(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()]
    return listed(spark, root, groups, scratch.folder(spark, "listed"))


def listed(spark: SparkSession, root: str, groups: list[str], out: str) -> DataFrame:
    import json

    spark.dataSource.register(listing.Listing)
    options = {"site": "lawmill.sources.listing:FolderSite", "root": root, "groups": json.dumps(groups), "exclude": '["view"]', "pages": "16"}
    stream = spark.readStream.format("listing").options(**options).load()
    run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("court_value string, page int, url string").parquet(out)
