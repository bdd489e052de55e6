"""Exact deduplication as a stream with state.

Two streaming queries run over a table that may grow. The first, without state, appends an
arrival for each row: digest of the normalised text, stable identifier and content locator (the
file, and the row's number in it). The second keeps a state by digest, on disk (RocksDB), without
expiry: the arrivals so far, and the identifier and locator of the row that stays. A further run
over the same folder takes only the files that are new, and meets all earlier digests there.

A hit is trusted only once full bytes are equal: the texts of all rows whose digest came more
than once are fetched by their locators and compared with one another. Rows of a digest whose
texts differ are grouped by their texts themselves.

Copies of one text are combined before each shuffle, so that a text of a third of all rows is a
row of each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from voxelframe.llm.common import ascii_lower, fresh_dir, stored

#: Bytes of files that one micro-batch takes.
BATCH_BYTES = 64 << 30
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Of the state's settings while its query starts; memory is bounded for all of an executor's partitions together.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Many small partitions would each reserve disk for logs, and an eighth of a write buffer of memory.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
}
LOCATOR = "struct<doc_id:bigint,file:string,row:bigint>"
ARRIVAL = f"digest string, at {LOCATOR}"
GROUP = f"digest string, n long, kept {LOCATOR}"


def normalised(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null is empty."""
    text = F.coalesce(text, F.lit(""))
    # Where every character is one byte, lower() knows A-Z alone, and is far quicker.
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(ascii_lower(text))


def _located(docs: DataFrame, doc_id: str) -> Column:
    """Identifier and locator of a row, in their order of staying: the largest doc_id, of equal ones the last place."""
    place = docs.metadataColumn("_metadata")
    return F.struct(F.col(doc_id).cast("long").alias("doc_id"), place["file_path"].alias("file"), place["row_index"].alias("row"))


def _run(writer: DataStreamWriter, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest(spark: SparkSession, path: str, home: str, text: str = "text", doc_id: str = "doc_id", digest_bits: int = 256, batch_bytes: int = BATCH_BYTES) -> None:
    """Take the Parquet files of ``path`` (a table's folder, or one file) that ``home`` doesn't know yet into its state.

    ``home`` holds the arrivals, the state and the groups; it must be shared by driver and
    executors. A run that was stopped goes on where its last complete micro-batch ended, and a
    batch that is run again writes the same. ``digest_bits`` of sha256 are told apart.
    """
    spark.createDataFrame([], ARRIVAL).write.mode("ignore").parquet(f"{home}/arrivals")
    spark.createDataFrame([], f"{GROUP}, batch long").write.mode("ignore").partitionBy("batch").parquet(f"{home}/groups")
    # As a pattern, a path may be one file as well.
    docs = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", batch_bytes).parquet(f"{path[:-1]}[{path[-1]}]")
    digest = F.sha2(normalised(docs[text]), 256)
    arrivals = docs.select(digest.alias("digest"), _located(docs, doc_id).alias("at"))
    _run(arrivals.writeStream.format("parquet").option("path", f"{home}/arrivals"), f"{home}/checkpoints/arrivals")
    log = spark.readStream.schema(ARRIVAL).option("maxBytesPerTrigger", batch_bytes).parquet(f"{home}/arrivals")
    state = log.groupBy(F.substring("digest", 1, digest_bits // 4).alias("digest")).agg(F.count("*").alias("n"), F.max("at").alias("kept"))

    def changed(groups: DataFrame, batch: int) -> None:
        groups.write.mode("overwrite").parquet(f"{home}/groups/batch={batch}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        _run(state.writeStream.outputMode("update").foreachBatch(changed), f"{home}/checkpoints/groups")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def groups(spark: SparkSession, home: str) -> DataFrame:
    """(digest, n, kept): the state of every digest. Counts and identifiers only grow, so the last is the largest."""
    seen = spark.read.schema(f"{GROUP}, batch long").parquet(f"{home}/groups")
    return seen.groupBy("digest").agg(F.max("n").alias("n"), F.max("kept").alias("kept"))


def settle(spark: SparkSession, path: str, home: str, text: str = "text", digest_bits: int = 256) -> DataFrame:
    """One row per arrival: doc_id, keep_id, group_size, kept, text_sha256, after checking the full bytes of hits."""
    arrivals = spark.read.schema(ARRIVAL).parquet(f"{home}/arrivals").withColumn("key", F.substring("digest", 1, digest_bits // 4))
    known = stored(groups(spark, home).withColumnRenamed("digest", "key"), "groups")
    members = stored(arrivals.join(known, "key"), "members")
    docs = spark.read.parquet(path)
    place = docs.metadataColumn("_metadata")
    content = docs.select(place["file_path"].alias("file"), place["row_index"].alias("row"), normalised(docs[text]).alias("body"))
    hits = members.filter("n > 1").select("key", "digest", "at", F.col("at.file").alias("file"), F.col("at.row").alias("row")).join(content, ["file", "row"])
    # All bytes of a digest's texts are equal when the least and the greatest text are.
    differ = hits.groupBy("key").agg(F.min("body").alias("least"), F.max("body").alias("most")).filter(F.col("least") != F.col("most"))
    differ = stored(differ.select("key"), "collisions")
    if not differ.isEmpty():
        own = hits.join(differ, "key")
        alike = own.groupBy("key", "body").agg(F.count("*").alias("n"), F.max("at").alias("kept"))
        parted = own.join(alike, ["key", "body"]).select("key", "digest", "at", "n", "kept")
        members = members.join(differ, "key", "left_anti").select(*parted.columns).unionByName(parted)
    return members.select(
        F.col("at.doc_id").alias("doc_id"),
        F.col("kept.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("at") == F.col("kept")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def deduplicate(spark: SparkSession, path: str, home: str | None = None, text: str = "text", doc_id: str = "doc_id", digest_bits: int = 256, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Rows of the table at ``path`` with the row of their group that stays.

    Texts are equal when they are once A-Z are lower-cased; a null text is an empty one. Of equal
    texts the row of largest doc_id stays; a null doc_id is smaller than all, and of repeated rows
    the one in the last place stays. Every row comes out once, repeated ones too. An empty table
    gives no rows. Extra columns are neither read nor returned, whatever their names.
    """
    home = home or fresh_dir(spark, "dedup")
    ingest(spark, path, home, text, doc_id, digest_bits, batch_bytes)
    return settle(spark, path, home, text, digest_bits)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY body ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)"""
