"""Exact deduplication as a stateful stream (operator 9).

Digests stream through a keyed aggregation whose state lives on disk (RocksDB) and never expires: for
each digest it retains the stable identifier of the row that stays, the number of rows and the content
locator of that row.  Rows are combined on the map side before they reach the state, so a text that a
third of all rows share is one row for each task there.  The rows are written once, with their texts, and a
locator (the call and the row in it) names one of them, in this call and all later ones with the same store.  On a hit (a digest seen more than once) the locator fetches the retained row's
bytes, and the least and the greatest text of the digest are compared with them: texts differ exactly if one
of the two does.  Digests that different texts share are regrouped by the texts themselves.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flagged, kept_rows, looked_up, scratch, text_or_empty, written

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    # a store that has committed gives its files back at once, however many partitions a task slot goes through
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def keep_state(spark: SparkSession, store: str) -> DataFrame:
    """Streams the rows below ``store`` that its state has not seen; (digest, order, locator, group_size) of all it has seen."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        # null ids count as the smallest; of rows with equal ids any one stays
        order = F.coalesce("doc_id", F.lit(-(2**63)))
        (
            spark.readStream.schema("doc_id long, digest string, batch long, row_id long")
            .parquet(f"{store}/rows")
            .groupBy("digest")
            .agg(F.max(order).alias("order"), F.max_by(F.struct("batch", "row_id"), order).alias("locator"), F.count("*").alias("group_size"))
            .writeStream.outputMode("update")
            .foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{store}/classes"))
            .option("checkpointLocation", f"{store}/state")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = there(spark, f"{store}/classes", "digest string, order long, locator struct<batch: long, row_id: long>, group_size long")
    # a digest that several micro-batches touched has a row of each, twice where one was run again; the last has the largest count
    return found.groupBy("digest").agg(F.max("group_size").alias("group_size"), F.max_by("order", "group_size").alias("order"), F.max_by("locator", "group_size").alias("locator"))


def there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``; no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


ROWS = "doc_id long, text_sha256 string, digest string, batch long, row_id long, text string"


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digest=None, store: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): a row for each row of ``docs``, dropped ones too.

    Null texts count as empty; empty texts are equal to each other.  Of rows with equal texts that with
    the largest doc_id stays (null ids count as the smallest); of rows with the same id and text exactly
    one stays.  ``digest`` (of a text column; SHA-256 unless given, and the same at each call with one store) may
    collide: full texts decide.  Other columns are left out.  An empty table gives no rows.

    store: a folder that driver and executors share.  It keeps rows, state and classes, so that a later call with it, in
    another session too, adds its rows to those before it, reads only the new ones into the state, and returns all of them.
    """
    spark = docs.sparkSession
    store = store or scratch(spark, "exact-store")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    whole = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_or_empty(f"`{text}`").alias("text"))
    key = (digest or sha)(F.col("text")).cast("string")
    last = there(spark, f"{store}/rows", ROWS).agg(F.max("batch")).first()[0]
    batch = F.lit(0 if last is None else last + 1).cast("long").alias("batch")
    # locators (call, row) are made once; what follows reads these files, so one means the same row after a lost executor and at later calls
    whole.select("doc_id", sha(F.col("text")).alias("text_sha256"), key.alias("digest"), batch, F.monotonically_increasing_id().alias("row_id"), "text").write.mode("append").option("compression", "zstd").parquet(f"{store}/rows")
    table = spark.read.schema(ROWS).parquet(f"{store}/rows").withColumn("at", F.struct("batch", "row_id")).drop("batch", "row_id")
    classes = written(keep_state(spark, store), "exact-last")
    if not collisions(table, classes):
        return marked(table.drop("text"), classes, "digest")
    # the digest did not tell texts apart: SHA-256 and text are the keys, and rows with an own class stand in for both
    order = F.coalesce("doc_id", F.lit(-(2**63)))
    exact = table.groupBy("text_sha256", "text").agg(F.max(order).alias("order"), F.max_by("at", order).alias("locator"), F.count("*").alias("group_size"))
    exact = written(exact.withColumn("class", F.concat_ws("/", "text_sha256", named(F.col("locator")))), "exact-texts")
    of = table.join(exact.select("text_sha256", "text", "class"), ["text_sha256", "text"]).drop("text", "digest")
    return marked(written(of, "exact-of"), exact.drop("text_sha256", "text"), "class")


def named(locator: Column) -> Column:
    return F.concat_ws(":", locator["batch"].cast("string"), locator["row_id"].cast("string"))


def marked(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """The result's columns for ``rows`` (doc_id, text_sha256, at, key) by ``classes`` (key, order, locator, group_size)."""
    total = rows.count()
    keep_id = F.when(F.col("order") != -(2**63), F.col("order"))
    out = looked_up(rows, classes, key, "group_size", total)
    return out.select("doc_id", keep_id.alias("keep_id"), "group_size", (F.col("at") == F.col("locator")).alias("kept"), "text_sha256")


def collisions(table: DataFrame, classes: DataFrame) -> bool:
    """Whether a hit's text differs from the bytes of the row that the locator of its class names."""
    hits = classes.filter("group_size > 1")
    # only texts that may be hits are compared, by the same plan at every size; a digest seen once has one text
    maybe = flagged(table.select("digest", "at", "text"), F.col("digest"), hits.select("digest"), "maybe").filter("maybe").drop("maybe")
    ends = maybe.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("greatest"))
    retained = flagged(maybe, named(F.col("at")), hits.select(named(F.col("locator")).alias("at")), "there").filter("there").select("at", F.col("text").alias("retained"))
    located = hits.select("digest", F.col("locator").alias("at")).join(retained, "at").drop("at")
    return not ends.join(located, "digest").filter("least != retained or greatest != retained").isEmpty()


def drop_exact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digest=None) -> DataFrame:
    """The rows of ``docs`` that stay, whole, with all their columns."""
    return kept_rows(docs, exact_groups(docs, text, doc_id, digest), text, doc_id)
