"""Hierarchical weighted hash tree: documents descend region, rack and shard by weighted hash draws.

At every level a row draws, for each child, an exponential time from a hash of its key and the child's name,
divided by the child's weight, and goes to the child with the earliest time.  A child's time depends on
nothing but the row, its name and its weight.  So where weights change, rows move only between the children of
the nodes on the way to the change, and where a subtree is added, rows move only into it.

Native: built-in functions only, no Python on the rows.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlake.session import cut_lineage

Leaf = tuple[str, str, int, float]      # region, rack, shard, weight

DRAW_DIGITS = 13                        # hexadecimal digits of a draw: 52 bits, exact in a double


def standard_tree(shards: int, base: int = 24, regions: int = 3, racks: int = 4) -> list[Leaf]:
    """`base` equal shards dealt over regions and racks; every shard beyond them is a region of its own.

    So whatever the number of shards, one more adds a subtree and takes rows only into itself.
    """
    base = min(base, shards)
    leaves: list[Leaf] = []
    for shard in range(base):
        region = shard * regions // base
        rack = shard * regions * racks // base
        leaves.append((f"region{region}", f"rack{rack}", shard, 1.0))
    return leaves + [(f"region+{s}", f"rack+{s}", s, 1.0) for s in range(base, shards)]


def _key(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("\u0000null"))


def _time(key: Column, name: Column, weight: Column) -> Column:
    """An exponential time of rate `weight`; null (never) where the weight is null or not above zero."""
    digits = F.substring(F.md5(F.concat(key, F.lit("/"), name)), 1, DRAW_DIGITS)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16 ** DRAW_DIGITS)
    return -F.ln(uniform) / F.when(weight > 0, weight)


def _pick(parent: Column, values: list[list], kind: str) -> Column:
    """values[parent] as an expression."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), parent)


def _descend(df: DataFrame, key: Column, tree: Sequence[Leaf], out: str) -> DataFrame:
    if not any(w > 0 for *_, w in tree):
        raise ValueError("no shard has a weight above zero")
    # nodes[level] lists (path, weight); the children of a node are the paths one longer that begin with it
    paths: list[dict[tuple, float]] = [{(): 0.0}, {}, {}, {}]
    shard_of: dict[tuple, int] = {}
    for region, rack, shard, weight in tree:
        path = (region, rack, str(shard))
        if path in shard_of:
            raise ValueError(f"shard {shard} is twice in the tree")
        shard_of[path] = shard
        for depth in (1, 2, 3):
            paths[depth][path[:depth]] = paths[depth].get(path[:depth], 0.0) + weight
    df = df.withColumn(out, F.lit(0))
    for depth in (1, 2, 3):
        parents, nodes = list(paths[depth - 1]), list(paths[depth])
        children = [[i for i, n in enumerate(nodes) if n[:-1] == p] for p in parents]
        times, numbers = [], []
        for place in range(max(map(len, children))):
            at = [c[place] if place < len(c) else None for c in children]
            names = [None if i is None else "/".join(nodes[i]) for i in at]
            weights = [None if i is None else paths[depth][nodes[i]] for i in at]
            parent = F.col(out)
            times.append(_time(key, _pick(parent, names, "string"), _pick(parent, weights, "double")))
            numbers.append(_pick(parent, at, "int"))
        named = [f"{out}__t{i}" for i in range(len(times))]
        kept = df.columns
        df = df.select("*", *[t.alias(n) for t, n in zip(times, named)])
        first = F.least(*map(F.col, named)) if len(named) > 1 else F.col(named[0])
        choice = numbers[-1]
        for name, number in reversed(list(zip(named[:-1], numbers[:-1]))):
            choice = F.when(F.col(name) == first, number).otherwise(choice)
        df = df.select(*[choice.alias(out) if c == out else F.col(f"`{c}`") for c in kept])
    leaf = [shard_of[p] for p in paths[3]]
    return df.withColumn(out, _pick(F.col(out), leaf, "int"))


def assign(docs: DataFrame, tree: Sequence[Leaf], id_col: str = "doc_id", out: str = "shard") -> DataFrame:
    """Every row of `docs` with `out`, the shard that its id descends to.  A column `out` is replaced.

    A null id is an id like any other, repeated rows go to the same shard, texts play no part, and an empty
    table stays empty.  Shards of weight zero (or a null weight) get no rows.
    """
    kept = [c for c in docs.columns if c != out]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), _key(F.col(f"`{id_col}`")).alias("key"))
    return _descend(rows, F.col("key"), tree, "shard").select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept], F.col("shard").alias(out))


def with_slots(rows: DataFrame, shard: str = "shard", order: Sequence[str] = ("doc_id",),
               bucket_rows: int = 2000, shards: int = 24) -> DataFrame:
    """Numbers the rows of every shard without gaps from 0, without putting a shard into one task.

    Rows are numbered inside hash buckets of a shard, and the buckets' sizes are summed up.  `rows` is read
    twice, so it should be a written table.
    """
    per_shard = rows.count() / max(1, shards)
    buckets = max(1, round(per_shard / bucket_rows))
    keyed = rows.withColumn("__bucket", F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(buckets)))
    sizes = keyed.groupBy(shard, "__bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(shard).alias("__s"), F.col("__bucket").alias("__b"),
                          F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(shard, "__bucket").orderBy(*order)
    return (keyed.withColumn("slot", F.row_number().over(inside).cast("long") - 1)
            .join(starts, (F.col(shard) == F.col("__s")) & (F.col("__bucket") == F.col("__b")))
            .withColumn("slot", F.col("slot") + F.col("__start"))
            .drop("__bucket", "__start", "__s", "__b"))


def write_shards(docs: DataFrame, tree: Sequence[Leaf], path: str, id_col: str = "doc_id") -> None:
    """Writes `docs` as Parquet with a folder for every shard that has rows."""
    assign(docs, tree, id_col, "shard").write.partitionBy("shard").parquet(path)


def manifest(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, under the law `key`.

    size: UTF-8 bytes of the text (null: none) plus 8; text_crc32 of a null text is that of the empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = assign(rows, standard_tree(shards), out="shard")
    rows = assign(rows, standard_tree(shards + 1), out="grown_shard")
    placed = with_slots(cut_lineage(rows), order=("doc_id", "text_crc32", "size"), shards=shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
