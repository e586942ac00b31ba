"""Sinks: derived tables, safe CSV, nested JSON, snapshots that only rewrite what changed, manifest."""
from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordlake.functions import ids
from recordlake.session import cut_lineage


def write_derived(tables: dict[str, DataFrame], path: str, partition: dict[str, str]) -> dict[str, int]:
    """SK1: one partitioned table each, with the row counts taken while writing."""
    counts = {}
    for name, df in tables.items():
        seen = Observation(name)
        writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
        if name in partition:
            writer = writer.partitionBy(partition[name])
        writer.parquet(f"{path}/{name}")
        counts[name] = seen.get["n"]
    return counts


def csv_safe(c) -> Column:
    """SK2: NULL becomes empty; a cell that a spreadsheet would run as a formula gets an apostrophe."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def safe_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[csv_safe(F.col(c)).alias(c) for c in columns])


def write_csv_safe(df: DataFrame, columns: list[str], path: str) -> None:
    """SK2: a fixed list of columns, in order."""
    safe_cells(df, columns).write.mode("overwrite").option("header", True).option(
        "emptyValue", "").csv(path)


def nested(meetings: DataFrame, items: DataFrame, meeting: str, order: str, fields: list[str],
           part_size: int = 1000) -> DataFrame:
    """SK3: one nested document per meeting and part: decisions in order.

    A part holds at most ``part_size`` item numbers, so a meeting of any length is written in pieces.
    """
    part = F.floor((F.col(order) - 1) / part_size).cast("int").alias("part")
    decisions = items.groupBy(meeting, part).agg(
        F.array_sort(F.collect_list(F.struct(order, *fields))).alias("decisions"))
    return meetings.join(decisions, meeting, "left").withColumn("part", F.coalesce("part", F.lit(0)))


def write_nested_json(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)


def changed_only(df: DataFrame, previous: DataFrame | None, key: str, content: Column) -> DataFrame:
    """SK4: rows whose input hash differs from the one stored for the key."""
    hashed = df.withColumn("input_sha256", ids.content_hash(content))
    if previous is None:
        return hashed
    return hashed.join(previous.select(key, "input_sha256"), [key, "input_sha256"], "left_anti").select(
        *df.columns, "input_sha256")


def publish_snapshot(df: DataFrame, path: str, partition: str, keep: int = 2) -> bool:
    """SK4: what this run produced and nothing else, as a new snapshot; False if nothing has changed.

    A snapshot is a list of partitions: what each holds (count and sums of hashes of its rows) and the folder it lies in.
    Only partitions that hold something else than before are written, to a new folder; the others stay where they are.
    The list is written last and counts once it is whole, so readers never see a part or none.  The newest ``keep`` lists
    stay, for readers that have begun; folders that none of them names are removed.
    """
    spark = df.sparkSession
    df = cut_lineage(df)
    columns = [F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]))]
    part = F.col(f"`{partition}`").cast("string")
    now = df.groupBy(part.alias("part")).agg(F.concat_ws("/", F.count("*"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")),
                                                         F.sum(F.crc32(columns[0].cast("binary")))).alias("content"))
    numbers = _lists(spark, path)
    before = (_read_list(spark, path, numbers[-1]) if numbers else spark.createDataFrame([], _LIST)).where("folder <> ''")
    same = F.col("now.part").eqNullSafe(F.col("was.part")) & (F.col("now.content") == F.col("was.content"))
    listed = cut_lineage(now.alias("now").join(before.alias("was"), same, "left").select("now.part", "now.content", "was.folder"))
    changed = listed.where("folder IS NULL").select(F.col("part").alias("_part"))
    n_changed, n_now = listed.agg(F.count_if(F.col("folder").isNull()), F.count("*")).first()
    if numbers and not n_changed and n_now == before.count():
        return False
    number = numbers[-1] + 1 if numbers else 1
    folder = f"data-{number:08d}-{uuid4().hex[:8]}"
    if n_changed:
        df.join(changed, part.eqNullSafe(F.col("_part")), "left_semi").write.partitionBy(partition).parquet(f"{path}/{folder}")
    # one row without a folder says what the columns are
    kinds = spark.createDataFrame([(None, df.schema.json(), "")], "part string, content string, folder string")
    (listed.select("part", "content", F.coalesce("folder", F.lit(folder)).alias("folder")).unionByName(kinds).coalesce(1)
     .write.mode("overwrite").parquet(f"{path}/_lists/{number:08d}"))
    kept = (numbers + [number])[-keep:]
    named = {r[0] for n in kept for r in _read_list(spark, path, n).select("folder").distinct().collect()}
    files, root = _files(spark, path)
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("data-") and name not in named:
            files.delete(status.getPath(), True)
    for n in numbers[:len(numbers) + 1 - keep] if keep <= len(numbers) else []:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_lists/{n:08d}"), True)
    return True


_LIST = "part string, content string, folder string"


def _files(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), root


def _lists(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the snapshots whose lists are whole; no more than are kept, and those that broke off."""
    files, _ = _files(spark, path)
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_lists")
    if not files.exists(place):
        return []
    found = [s.getPath() for s in files.listStatus(place)]
    return sorted(int(p.getName()) for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _read_list(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.schema(_LIST).parquet(f"{path}/_lists/{number:08d}")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot that is whole."""
    parts = _read_list(spark, path, _lists(spark, path)[-1])
    schema = StructType.fromJson(json.loads(parts.where("folder = ''").first()["content"]))
    out = spark.createDataFrame([], schema)
    for folder in sorted(r[0] for r in parts.where("folder <> ''").select("folder").distinct().collect()):
        here = parts.where(F.col("folder") == folder).select(F.col("part").alias("_part"))
        rows = spark.read.schema(schema).parquet(f"{path}/{folder}")
        # the partition column is the last one of a folder that is read with its partitions
        kept = rows.join(here, F.col(f"`{rows.columns[-1]}`").cast("string").eqNullSafe(F.col("_part")), "left_semi")
        out = out.unionByName(kept)
    return out


def build_manifest(tables: dict[str, DataFrame], date: tuple[str, str], layer: str) -> DataFrame:
    """SK5: (key, value) rows: a count per table, the newest date, the layer's label."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").cast("string").alias("value")).select(F.lit(f"n_{name}").alias("key"), "value")
        out = row if out is None else out.unionByName(row)
    name, column = date
    newest = tables[name].agg(F.date_format(F.max(column), "yyyy-MM-dd").alias("value")).select(
        F.lit("newest").alias("key"), "value")
    label = newest.select(F.lit("layer").alias("key"), F.lit(layer).alias("value"))
    return out.unionByName(newest).unionByName(label)
