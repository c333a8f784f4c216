"""Exact deduplication as a stateful stream.

A stream aggregation keeps, for every digest, the number of rows, the identifier of the row that stays with the file its
content lies in, and the file of the row that came first. The state has no watermark and so never expires; it lives in
RocksDB on the executors' disks and in the checkpoint folder, so that a later run with the same folder goes on where the
last one ended. Rows that hit a digest already held are then compared byte by byte, with rows of the same run and, by the
file in the state, with the first of an earlier run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored, unused

#: Settings of the state store. Without the last two, every store sets megabytes of disk aside, however few keys it has.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
SALTS = 16
#: The bitmap of hits: 2^23 bits in pieces of 2^15, as Spark's bitmap functions make them.
BITS, PIECE = 1 << 23, 1 << 15


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable = sha256, run: int = 0) -> DataFrame:
    """One slim row per document: id, digest of the whole text (null counts as empty), the run and the file it lies in."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("id"), digest(text).alias("digest"), F.lit(run).cast("long").alias("run"), F.input_file_name().alias("locator"))


def run_state(spark: SparkSession, slim_path: str, schema, state_dir: str, files_per_batch: int = 4096) -> DataFrame:
    """Feed the slim rows below slim_path through the keyed state in state_dir.

    Gives the states as they were after each batch: counts and kept ids only grow, first rows stay. An empty table of
    slim rows gives none.
    """
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    updates = f"{state_dir}/updates"
    keep, first = F.struct("id", "locator"), F.struct("run", "locator")
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(slim_path)
        state = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max(keep).alias("keep"), F.min(first).alias("first"))
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{state_dir}/stream")
            .foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{updates}/batch={k}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kind = schema["id"].dataType.simpleString()
    fields = f"digest string, n long, keep struct<id:{kind},locator:string>, first struct<run:long,locator:string>, batch int"
    return spark.read.schema(fields).parquet(updates) if _exists(spark, updates) else spark.createDataFrame([], fields)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def _cell(digest: Column) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(BITS))


def _bitmap(hits: DataFrame) -> DataFrame:
    """One row: a bitmap of fixed size that holds the hashes of all digests of hits, and some others."""
    cell = _cell(F.col("digest"))
    pieces = hits.select(F.floor(cell / F.lit(PIECE)).cast("int").alias("piece"), (cell % F.lit(PIECE)).alias("bit"))
    pieces = pieces.groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return pieces.agg(F.map_from_entries(F.collect_list(F.struct("piece", "bits"))).alias("hit_bits"))  # 1 MB at most


def _maybe_hit(digest: Column) -> Column:
    cell = _cell(digest)
    bits = F.try_element_at("hit_bits", F.floor(cell / F.lit(PIECE)).cast("int"))
    bit = cell % F.lit(PIECE)
    byte = F.conv(F.hex(F.substring(bits, F.floor(bit / F.lit(8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.floor(byte / F.pow(F.lit(2), bit % F.lit(8))).cast("int") % 2 == 1, F.lit(False))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable = sha256, state_dir: str | None = None, read: Callable | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, digest.

    Equal means equal bytes; null counts as empty. The row with the largest id stays. Rows that repeat an id with the
    same text count in group_size and share its decision. A table without rows gives none. Other columns are ignored.
    Digests that turn out to hold different bytes (none, for SHA-256) are told apart by the bytes themselves, among the
    rows of this run. With the state_dir of earlier runs their rows count too; `read` (spark, paths) gives the documents
    of their files, Parquet by default, and a row whose bytes differ from what they hold raises an error.
    """
    spark = docs.sparkSession
    state_dir = state_dir or scratch(spark, "exact-dedup")
    runs = f"{state_dir}/slim"
    run = spark.read.parquet(f"{runs}/*").agg(F.max("run")).first()[0] + 1 if _exists(spark, runs) else 0
    slim = digests(docs, id_col, text_col, digest, run)
    slim.write.parquet(f"{runs}/run-{run:08d}")
    schema = slim.schema
    slim = spark.read.schema(schema).parquet(f"{runs}/run-{run:08d}")
    updates = run_state(spark, f"{runs}/*", schema, state_dir)
    state = updates.groupBy("digest").agg(F.max("n").alias("n"), F.max("keep").alias("keep"), F.min("first").alias("first"))

    # the whole bytes of every hit, equal ones put together before they are shuffled; salts spread a digest with many rows
    hits = state.filter("n > 1").select("digest")
    salted = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")

    def full(source: DataFrame) -> DataFrame:
        text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
        return source.select(F.col(id_col).alias("id"), text.alias("bytes")).withColumn("digest", digest(F.col("bytes"))).withColumn("salt", salt)

    likely = full(docs).join(F.broadcast(_bitmap(hits))).filter(_maybe_hit(F.col("digest"))).drop("hit_bits")  # one row of 1 MB
    same = likely.join(salted, ["digest", "salt"], "left_semi").groupBy("digest", "bytes").agg(F.count("*").alias("n"))
    clash = stored(same.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"), "digest-clash")
    if run:
        earlier = stored(state.filter(F.col("first.run") < run).select("digest", "first.locator").join(slim.select("digest").distinct(), "digest"), "held-earlier")
        files = [r["locator"] for r in earlier.select("locator").distinct().collect()]  # names of files, as a reader needs them
        if files:
            read = read or (lambda s, paths: s.read.parquet(*paths))
            held = full(read(spark, files)).join(earlier.select("digest"), "digest", "left_semi").select("digest", "bytes").distinct()
            mine = likely.join(salted, ["digest", "salt"], "left_semi").select("digest", "bytes").distinct()
            wrong = mine.join(earlier.select("digest"), "digest", "left_semi").join(held, ["digest", "bytes"], "left_anti")
            if not wrong.isEmpty():
                raise ValueError("a digest of an earlier run is held by other bytes: choose a stronger digest")
    plain = slim.join(state, "digest").select(F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), "digest")
    if not clash.isEmpty():
        apart = full(docs).join(clash, "digest", "left_semi")
        classes = apart.groupBy("digest", "bytes").agg(F.count("*").alias("group_size"), F.max("id").alias("keep_id"))
        told = apart.join(classes, ["digest", "bytes"]).select(F.col("id").alias(id_col), "keep_id", "group_size", "digest")
        plain = plain.join(clash, "digest", "left_anti").unionByName(told)
    return plain.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns; of rows that repeat an id and text, one.

    Null texts are copies of empty ones. An empty table stays empty; columns of docs may have any names.
    """
    found = exact_dedup(docs, id_col, text_col).filter("kept")
    kept = stored(found.groupBy(F.col(id_col).alias("_id"), F.col("digest").alias("_digest")).agg(F.count("*").alias("_rows")), "kept")
    mine = unused(docs, "_text_digest")
    marked = docs.withColumn(mine, sha256(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    of = lambda left, k: left[id_col].eqNullSafe(k["_id"]) & (left[mine] == k["_digest"])
    once = marked.join(kept, of(marked, kept), "left_semi")
    repeated = kept.filter("_rows > 1")
    if not repeated.isEmpty():
        again = once.join(repeated, of(once, repeated), "left_semi").dropDuplicates([id_col, mine])
        once = once.join(repeated, of(once, repeated), "left_anti").unionByName(again)
    return once.drop(mine)
