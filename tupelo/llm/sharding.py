"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Equal texts form a group, which goes to one shard as a whole: the one where the dot product of the
group's bytes, tokens and rows with the shard's residual capacity is highest, the largest groups
first. Groups that weigh more than a part of a shard, of which there are at most shards x parts in
each dimension, are placed one by one on the driver. All others are dealt by hash into cells of about
`cell` groups; each cell has its part of what the large ones have left of every shard, and places
its groups into that by the same rule, so sizes come out near equal (law `bytes`) whatever the number
of groups. A group too large for a shard is dealt out over several pieces by its rows, also those
of one id, the only case in which equal texts part; what has fallen to each piece is counted before
it is placed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import free_name, id_keys, numbered_repeats, own_columns, paired, saved, scratch, ship, text_keys

WORD = r"[^\x20\x09-\x0D]+"
SIZES = ("size", "tokens", "rows")
#: Bytes weigh more than tokens and rows, as their law is the one to hold.
WEIGHT = np.array([32.0, 1.0, 1.0])


def place(vectors: np.ndarray, shards: int, room: np.ndarray | None = None, first: int = 0) -> np.ndarray:
    """The shard of each item; vectors: its bytes, tokens and rows.

    room: what each shard has left of each, by default an equal part of the totals; all is measured
    in the mean room. Items are taken by their largest part of it, in order if equal. Ties go to the
    first shard from `first` on, around the end.
    """
    room = np.repeat(vectors.sum(0, keepdims=True) / shards, shards, axis=0) if room is None else room
    mean = np.maximum(room.mean(0), 1e-9)
    unit, left = vectors / mean, np.roll(room / mean, -first, axis=0)
    out = np.zeros(len(vectors), np.int64)
    for k in np.lexsort((np.arange(len(unit)), -unit.max(1))):
        # Rounded, so that a tie is one whatever the order of the sums.
        out[k] = np.round(left @ (WEIGHT * unit[k]), 9).argmax()
        left[out[k]] -= unit[k]
    return (out + first) % shards


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """doc_id, size (UTF-8 bytes and overhead), tokens, text_crc32 (null text: as empty), group (two hashes)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    base = own_columns(docs, doc_id, text).toDF("doc_id", "text")
    return base.select(
        "doc_id",
        (F.octet_length(t) + F.lit(overhead)).cast("long").alias("size"),
        F.regexp_count(t, F.lit(WORD)).cast("long").alias("tokens"),
        F.crc32(t).alias("text_crc32"),
        *[c.alias(k) for k, c in text_keys(F.col("text")).items()],
    )


def assign(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", parts: int = 64, ranks: int = 256, cell: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, size, tokens, text_crc32, g1, g2, nth, shard (int), slot (long), piece.

    slot counts each shard's rows from 0 without gaps, in an order of its own; nth counts the rows of
    an id and text. Null texts are a group, sized as empty; null ids and repeated rows take slots
    like others. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    key = ["g1", "g2"]
    with scratch(spark):
        rows = measured(docs, doc_id, text).withColumns(dict(zip(("_id", "_none"), id_keys(F.col("doc_id")), strict=True)))
        rows = numbered_repeats(rows, ["_id", "_none", *key], "sizes")
        sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
        groups = saved(rows.groupBy(*key).agg(*sums), "groups")
        total = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SIZES], F.count("*").alias("groups")).first()
        heavy_if = F.greatest(*[F.col(c) * F.lit(shards * parts / max(1, total[c])) for c in SIZES]) > 1
        heavy = groups.where(heavy_if).select(*key, *SIZES).orderBy(*key).toPandas()  # at most 3 x shards x parts rows

        # A heavy group gets so many pieces that several fit a shard.
        share = np.max([heavy[c].to_numpy(float) * shards / max(1, total[c]) for c in SIZES], axis=0) if len(heavy) else np.zeros(0)
        pieces = np.where(share > 1, np.minimum(np.ceil(8 * share), heavy["rows"].to_numpy(float)), 1).astype(np.int64)
        split = pieces > 1
        many = F.broadcast(spark.createDataFrame([*zip(heavy["g1"][split].tolist(), heavy["g2"][split].tolist(), pieces[split].tolist(), strict=True)], "g1 long, g2 long, pieces int"))
        piece = F.pmod(F.xxhash64("_id", "_none", "nth", F.lit(3)), F.col("pieces")).cast("int")
        parted = rows.join(many, key, "left").withColumn("piece", F.coalesce(piece, F.lit(0))).drop("pieces", "_id", "_none")
        items = heavy[~split].assign(piece=0)
        if split.any():
            counts = rows.join(many, key).withColumn("piece", piece).groupBy(*key, "piece").agg(*sums)
            items = pd.concat([items, counts.orderBy(*key, "piece").toPandas()], ignore_index=True)  # about 8 x 3 x shards pieces
        vectors, room = items[list(SIZES)].to_numpy(float), np.array([[total[c] / shards for c in SIZES]] * shards)
        heavy_shard = place(vectors, shards, room)
        np.subtract.at(room, heavy_shard, vectors)
        heavy_rows = zip(*[items[c].tolist() for c in (*key, "piece")], heavy_shard.tolist(), strict=True)
        heavy_at = F.broadcast(spark.createDataFrame([*heavy_rows], "g1 long, g2 long, piece int, heavy_shard int"))

        cells = max(1, -(-(total["groups"] - len(heavy)) // cell))
        light = groups.where(~heavy_if).withColumn("cell", F.pmod(F.xxhash64("g1", "g2", F.lit(2)), F.lit(cells)))
        light = saved(placed(light, np.maximum(room, 0), shards), "light", keep=True)
    # The heavy ones' table has been bounded above; without their rows the join by group has no hot key.
    columns = ["doc_id", "size", "tokens", "text_crc32", "g1", "g2", "nth", "shard", "piece"]
    found = parted.join(heavy_at.withColumnRenamed("heavy_shard", "shard"), [*key, "piece"]).select(columns)
    rest = parted.join(F.broadcast(heavy_at.select(*key).distinct()), key, "left_anti").join(light.withColumnRenamed("light_shard", "shard"), key)
    return numbered(found.union(rest.select(columns)), shards, ranks)


def placed(light: DataFrame, room: np.ndarray, shards: int) -> DataFrame:
    """g1, g2 and light_shard of groups (g1, g2, sizes, cell), each cell placed by itself."""
    dealt = light.select("cell", "g1", "g2", *SIZES).repartition("cell").sortWithinPartitions("cell", "g1", "g2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(table: pa.Table) -> pa.RecordBatch:
            vectors = np.stack([table.column(c).to_numpy() for c in SIZES], axis=1).astype(float)
            own = room * (vectors.sum(0) / np.maximum(room.sum(0), 1e-9))
            # Each cell begins with another shard, so that what is over in a cell doesn't add up in one.
            shard = place(vectors, shards, own, table.column("cell")[0].as_py() % shards)
            return pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks() for c in ("g1", "g2")], pa.array(shard.astype(np.int32))], names=["g1", "g2", "light_shard"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b and held and held[-1].column("cell")[0].as_py() != cell[a]:
                    yield packed(pa.Table.from_batches(held))
                    held = []
                if a < b:
                    held.append(batch.slice(a, b - a))
        if held:
            yield packed(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "g1 long, g2 long, light_shard int")


def numbered(found: DataFrame, shards: int, ranks: int) -> DataFrame:
    """found with slot: the rows of a shard are dealt to `ranks` parts by their ids, each part is
    numbered by itself, and starts where the parts before it end."""
    rank = F.pmod(F.xxhash64("doc_id", "g1", "nth", F.lit(5)), F.lit(ranks)).cast("int")
    found = found.withColumn("rank", rank)
    sums = found.groupBy("shard", "rank").agg(F.count("*").alias("n"))  # at most shards x ranks rows
    start = (F.sum("n").over(Window.partitionBy("shard").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))).alias("start")
    starts = F.broadcast(sums.select("shard", "rank", F.coalesce(start, F.lit(0)).alias("start")))
    nth = F.row_number().over(Window.partitionBy("shard", "rank").orderBy("doc_id", "g1", "g2", "nth"))
    return found.withColumn("_at", nth).join(starts, ["shard", "rank"]).withColumn("slot", F.col("start") + F.col("_at") - 1).drop("_at", "start", "rank")


def sharded(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", **packing) -> DataFrame:
    """docs, all columns kept, with shard and slot (under other names if docs has these).

    Rows with the same id and text are interchangeable.
    """
    names = {c: free_name(docs, c) for c in ("shard", "slot")}
    return paired(docs, assign(docs, shards, doc_id, text, **packing), doc_id, text, names)
