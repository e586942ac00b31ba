"""Structured Streaming jobs.  Each has a batch twin that must give the same rows."""
from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recordlake.functions import lexicons as lx
from recordlake.operators.running import running
from recordlake.session import cut_lineage
from recordlake.streaming.state import BUCKETS, BucketTable


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_trigger: int = 8
                ) -> DataFrame:
    """A table, or the Parquet files of a folder whose names fit, as a stream; the trigger size bounds each batch.

    A table that is a folder of part files is read from that folder.
    """
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    if found and any(f.isDirectory() for f in found):
        return files.parquet(f"{folder}/{pattern}")
    return files.option("pathGlobFilter", pattern).parquet(folder)


def ingest_versions(stream: DataFrame, out: str, checkpoint: str, key: str, order: list[str],
                    content: str, chunk: Column, buckets: int = BUCKETS):
    """ST1: version log of a stream of fetches.  Batch twin: ``timeline.version_chain``.

    A fetch without content failed: it is kept apart and the working version stays.  Every batch is
    compared, in order, with the last version of its keys; ``running`` splits a busy key in chunks.
    The last versions are a table of their own, of which a batch reads and replaces the buckets of its keys; the log is
    only written.  The folder of a batch is overwritten when the batch is run again, so a retry cannot add twice.
    """
    fields = [f.name for f in stream.schema.fields]
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = f"`{key}` {kinds[key]}, `{content}` {kinds[content]}, version bigint"

    def merge(batch: DataFrame, batch_id: int) -> None:
        state = BucketTable(batch.sparkSession, f"{out}/current", schema, [key], buckets)
        batch.where(F.col(content).isNull()).write.mode("overwrite").parquet(f"{out}/failed/batch_id={batch_id}")
        fresh = batch.where(F.col(content).isNotNull()).withColumn("_base", F.lit(None).cast("bigint"))
        touched = state.touched(fresh)
        known = state.read(state.before(batch_id), touched)
        last = known.join(fresh.select(key).distinct(), key, "left_semi").withColumnRenamed("version", "_base")
        both = fresh.unionByName(last, allowMissingColumns=True).withColumn("_seed", F.col("_base").isNotNull()).withColumn(
            "_late", F.when(F.col("_seed"), 0).otherwise(1))
        # The stored version comes first whatever its time stamp says.
        compared = running(both, [key], F.when(~F.col("_seed"), chunk), ["_late", *order], last=[content])
        changed = compared.where(~F.col("_seed") & ~F.col(f"prev_{content}").eqNullSafe(F.col(content)))
        numbered = running(changed, [key], chunk, order, sums={"_n": F.lit(1).cast("bigint")})
        base = last.select(F.col(key).alias("_k"), F.col("_base").alias("_b"))
        version = F.col("_n") + F.coalesce("_b", F.lit(0))
        log = f"{out}/versions/batch_id={batch_id}"
        (numbered.join(base, F.col(key) == F.col("_k"), "left")
         .withColumn("version", version.cast("bigint"))
         .withColumn("status", F.when(F.col("version") == 1, "new").otherwise("changed"))
         .select(*fields, "version", "status").write.mode("overwrite").parquet(log))
        written = batch.sparkSession.read.parquet(log).select(key, content, "version").unionByName(known)
        state.replace(batch_id, written.groupBy(key).agg(F.max_by(F.struct(content, "version"), "version").alias("l")).select(key, "l.*"), touched)
    return (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


# ---- rate limit ------------------------------------------------------------------------------------------

def _admit(times: list[float], kept: list[float], limit: int, window: float, late: float = 0.0
           ) -> tuple[list[int], list[float]]:
    """Waits (0 when accepted) for hits in time order; only accepted hits stay, for a window and `late` seconds more.

    A hit that came late counts the accepted hits of the window before it; what was judged before stays as it is.
    """
    waits = []
    for now in times:
        if kept and now >= kept[-1]:
            kept = [k for k in kept if k > now - window - late]
        near = [k for k in kept if now - window < k <= now]
        if len(near) >= limit:
            waits.append(max(1, int(near[len(near) - limit] + window - now) + 1))
        else:
            insort(kept, now)
            waits.append(0)
    return waits, kept


def rate_limit(stream: DataFrame, key: str, time: str, ident: str,
               limit: int = lx.RATE_LIMIT_HITS, window: float = lx.RATE_LIMIT_SECONDS,
               late: float = 3600.0) -> DataFrame:
    """ST2: seconds to wait for every hit, late ones too.

    State per client: the accepted hits of a window and of `late` seconds before it, gone when the client stays away
    for twice that long.  There is no watermark, so no hit is dropped; one that comes later than `late` is judged by
    what is still known. 
    """
    use_rocksdb(stream.sparkSession)
    forget = int(max(3600.0, 2 * (window + late)) * 1000)

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits = pd.concat(list(batches)).sort_values(["seconds", ident])
        waits, kept = _admit(hits["seconds"].tolist(), list(state.get[0]) if state.exists else [], limit, window, late)
        state.update((kept,))
        state.setTimeoutDuration(forget)
        yield pd.DataFrame({key: k[0], ident: hits[ident].to_numpy(), "wait": waits})
    return stream.withColumn("seconds", F.unix_micros(time) / 1e6).groupBy(key).applyInPandasWithState(
        step, f"{key} bigint, {ident} bigint, wait bigint", "kept array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def use_rocksdb(spark: SparkSession) -> None:
    """Keys that may outgrow memory need this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def rate_limit_batch(hits: DataFrame, key: str, seconds: str, ident: str, chunk: Column,
                     limit: int = lx.RATE_LIMIT_HITS, window: float = lx.RATE_LIMIT_SECONDS) -> DataFrame:
    """ST2, batch twin.  After a pause of a whole window nothing is remembered, so each client's log
    falls apart into bursts that are judged on their own.

    The bursts are sorted and walked batch by batch with the few accepted hits as the only state, so a
    long burst never has to fit in memory.
    """
    order = [seconds, ident]
    paused = running(hits.select(key, ident, seconds), [key], chunk, order, last=[seconds])
    opens = (F.col(f"prev_{seconds}").isNull() | (F.col(seconds) - F.col(f"prev_{seconds}") >= window))
    bursts = running(paused, [key], chunk, order, sums={"burst": opens.cast("bigint")})

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = None, []
        for pdf in batches:
            waits: list[int] = []
            for part, rows in pdf.groupby([key, "burst"], sort=False):
                if part != current:
                    current, kept = part, []
                found, kept = _admit(rows[seconds].tolist(), kept, limit, window)
                waits += found
            yield pd.DataFrame({key: pdf[key].to_numpy(), ident: pdf[ident].to_numpy(), "wait": waits})
    walked = bursts.repartition(key, "burst").sortWithinPartitions(key, "burst", *order)
    return walked.mapInPandas(judge, f"{key} bigint, {ident} bigint, wait bigint")


# ---- watch, counts, cache --------------------------------------------------------------------------------

def watch_new(stream: DataFrame, known: DataFrame, url: str, host: Column) -> DataFrame:
    """ST3: the sighting of every address on the trusted host that is not known yet, once for ever.

    Addresses seen stay in the state store, on disk; there is no watermark, so a late one is not lost and none comes twice.
    """
    use_rocksdb(stream.sparkSession)
    return stream.where(host).dropDuplicates([url]).join(known.select(url).distinct(), url, "left_anti")


def topic_counts(stream: DataFrame, out: str, checkpoint: str, time: str, topic: str, bucket: str = "1 day", buckets: int = BUCKETS):
    """ST4: counts per topic and time bucket, of every row whenever it comes; the newest buckets are there too.

    A batch is counted by itself and added to the counts of its time buckets: a table by bucket, of which it reads and replaces
    what it touches.  Read the table with ``topic_table``.
    """
    kind = {f.name: f.dataType.simpleString() for f in stream.schema.fields}[topic]
    schema = f"start timestamp, `{topic}` {kind}, n bigint"

    def add(batch: DataFrame, batch_id: int) -> None:
        state = BucketTable(batch.sparkSession, out, schema, ["start"], buckets)
        fresh = cut_lineage(batch.groupBy(F.window(time, bucket).alias("w"), topic).agg(F.count("*").alias("n"))
                            .select(F.col("w.start").alias("start"), topic, "n"))
        touched = state.touched(fresh)
        both = fresh.unionByName(state.read(state.before(batch_id), touched))
        state.replace(batch_id, both.groupBy("start", topic).agg(F.sum("n").alias("n")), touched)
    return (stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def topic_table(spark: SparkSession, out: str, topic: str, kind: str = "string", buckets: int = BUCKETS) -> DataFrame:
    """ST4: the counts as they are now."""
    return BucketTable(spark, out, f"start timestamp, `{topic}` {kind}, n bigint", ["start"], buckets).rows()


def result_cache(stream: DataFrame, cache: str, checkpoint: str, key: str, work, schema: str, buckets: int = BUCKETS):
    """ST5: only keys that are not cached are worked on; results are kept by key, under ``results``.

    ``work`` takes the frame of missing keys and returns key and result columns, ``schema`` in DDL.  The keys that are there are a table by
    bucket, of which a batch reads and replaces what it touches; results are only written.
    """
    kind = {f.name: f.dataType.simpleString() for f in stream.schema.fields}[key]

    def step(batch: DataFrame, batch_id: int) -> None:
        state = BucketTable(batch.sparkSession, f"{cache}/keys", f"`{key}` {kind}", [key], buckets)
        touched = state.touched(batch)
        known = state.read(state.before(batch_id), touched)
        missing = batch.dropDuplicates([key]).join(known, key, "left_anti")
        log = f"{cache}/results/batch_id={batch_id}"
        work(missing).write.mode("overwrite").parquet(log)
        state.replace(batch_id, batch.sparkSession.read.schema(schema).parquet(log).select(key).unionByName(known), touched)
    return (stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def run_to_table(result: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there now into a parquet table and reads the table.

    Batches without rows are left out meanwhile: with a time to live they would never end.
    """
    spark, empty = result.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(empty)
    spark.conf.set(empty, "false")
    try:
        (result.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()).awaitTermination()
    finally:
        spark.conf.set(empty, before)
    return spark.read.schema(result.schema).parquet(out)
