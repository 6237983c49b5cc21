"""Sharding by fixed virtual slots: DataFrame functions only.

A record's virtual slot is a hash of its key; a versioned map, stored as a table of edits, assigns the slots to shards.
Growing edits the map: the new shard takes over every k-th slot of the old ones, so that
records move only into it. ``rebalance`` edits the map by the bytes counted for each slot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_dir, stored

#: Virtual slots; fixed for good, as records find their shard by them.
SLOTS = 4096
#: Parts of a virtual slot that are numbered apart, so that no task numbers a whole shard.
PARTS = 16


def _hex_mod(key: Column, first: int, modulus: int) -> Column:
    """A number below ``modulus`` from eight hex digits of the key's MD5, from position ``first``."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), first, 8), 16, 10).cast("long") % modulus


def virtual_slot(key: Column) -> Column:
    return F.coalesce(_hex_mod(key, 1, SLOTS), F.lit(0).cast("long")).cast("int")


def initial_map(spark: SparkSession, shards: int) -> DataFrame:
    """Version 1: ``vslot, shard, version``, a function of the shard count alone, as if shards had been added one by one.

    When the n-th shard came, each slot moved into it whose hash with n is divisible by n: one in n of all slots.
    """
    shard = F.lit(0)
    for n in range(2, shards + 1):
        shard = F.when(_moves(F.col("vslot"), n), F.lit(n - 1)).otherwise(shard)
    return spark.range(SLOTS).select(F.col("id").cast("int").alias("vslot")).select("vslot", shard.cast("int").alias("shard"), F.lit(1).alias("version"))


def _moves(vslot: Column, n: int) -> Column:
    return _hex_mod(F.concat(vslot.cast("string"), F.lit(f"/{n}")), 1, n) == 0


def grow(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version, with shard number ``shards`` added; slots move only into it."""
    return slot_map.select("vslot", F.when(_moves(F.col("vslot"), shards + 1), F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"), (F.col("version") + 1).alias("version"))


class SlotMap:
    """The stored map: a Parquet table of edits (``vslot, shard, version``), one folder for each version.

    Version 1 has all slots; a later one has the slots alone that it moves. A reader of version v takes each slot's last edit up to v.
    At most SLOTS rows a version.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.versions = spark, path, 0

    def store(self, edited: DataFrame) -> int:
        """Write the next version: the slots of ``edited`` (all of them) whose shard is another one than before."""
        version = self.versions + 1
        if self.versions:
            before = self.read().select("vslot", F.col("shard").alias("_before"))
            edited = edited.join(before, "vslot").where(F.col("shard") != F.col("_before"))
        edited.select("vslot", "shard", F.lit(version).alias("version")).coalesce(1).write.parquet(f"{self.path}/v{version}")
        self.versions = version
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """``vslot, shard, version`` of all slots as of a version (the last one); ``version`` is that one, whichever edit placed the slot."""
        last = version or self.versions
        edits = self.spark.read.schema("vslot int, shard int, version int").parquet(*[f"{self.path}/v{v}" for v in range(1, last + 1)])
        return edits.groupBy("vslot").agg(F.max_by("shard", "version").alias("shard")).select("vslot", "shard", F.lit(last).alias("version"))


def slot_bytes(records: DataFrame) -> DataFrame:
    """``vslot, rows, bytes`` from rows with ``vslot`` and ``size``: at most one row for each slot."""
    return records.groupBy("vslot").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


def rebalance(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version, edited by bytes: slots beyond a shard's fair share of bytes go to the shards below theirs.

    Works on one row for each slot (SLOTS at most), in slot order: a slot stays while its shard's running
    bytes are within the mean; the others are laid out over the free room of all shards. Slots without bytes stay.
    All in whole numbers: bytes times the number of shards, against the sum of all bytes.
    """
    m = slot_map.join(loads.select("vslot", "bytes"), "vslot", "left").fillna(0, ["bytes"]).withColumn("load", F.col("bytes") * shards)
    run = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(0))
    m = m.withColumn("total", F.sum("bytes").over(every)).withColumn("moves", (F.sum("load").over(run) > F.col("total")) & (F.col("bytes") > 0))
    kept = m.groupBy("shard").agg(F.max("total").alias("total"), F.sum(F.when(F.col("moves"), F.lit(0).cast("long")).otherwise(F.col("load"))).alias("kept")).collect()  # a row for each shard
    total, kept_of = max((r["total"] for r in kept), default=0), {r["shard"]: r["kept"] for r in kept}
    to, upto = F.lit(None).cast("int"), 0
    for shard, end in reversed([(k, upto := upto + max(0, total - kept_of.get(k, 0))) for k in range(shards)]):
        to = F.when(F.col("mid") < end, shard).otherwise(to)
    moved = m.where("moves").withColumn("mid", F.sum("load").over(every.orderBy("vslot").rowsBetween(Window.unboundedPreceding, 0)) - F.expr("load div 2"))
    placed = moved.select("vslot", to.alias("to"))
    return slot_map.join(F.broadcast(placed), "vslot", "left").select("vslot", F.coalesce("to", "shard").alias("shard"), (F.col("version") + 1).alias("version"))


def shard_records(docs: DataFrame, shards: int) -> DataFrame:
    """Each record's shard under the key law, its gapless position there, and its shard after one more was added.

    ``doc_id`` and the shard count decide the shard. Three versions of the slot map are stored and read back: the first for
    ``shards``, the second after growing by one, the third after rebalancing the first by the bytes counted for each slot (``balanced_shard``,
    which the key law doesn't use). The shuffle carries ids and sizes only, dealt by (virtual slot,
    part); positions are a part's offset (from SLOTS * PARTS counts) plus the row's number in its part. The maps and the
    offsets are broadcast: SLOTS and SLOTS * PARTS rows at most. Null text: 8 bytes, checksum 0. Null ids: slot 0. Repeated
    rows get positions of their own. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).select("*", virtual_slot(F.col("doc_id")).alias("vslot"))
    rows = rows.withColumn("part", _hex_mod(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("size").cast("string"), F.col("text_crc32").cast("string")), 9, PARTS).cast("int"))
    parts = stored(rows.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")), "slot-parts")
    loads = parts.groupBy("vslot").agg(F.sum("bytes").alias("bytes"))
    maps = SlotMap(spark, f"{scratch_dir(spark)}/slot-map-{uuid.uuid4().hex}")
    first = maps.store(initial_map(spark, shards))
    grown = maps.store(grow(maps.read(first), shards))
    balanced = maps.store(rebalance(maps.read(first), loads, shards))
    one = maps.read(first).join(F.broadcast(maps.read(grown).select("vslot", F.col("shard").alias("grown_shard"))), "vslot")
    one = one.join(F.broadcast(maps.read(balanced).select("vslot", F.col("shard").alias("balanced_shard"))), "vslot")
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.join(F.broadcast(one), "vslot").withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    placed = placed.join(F.broadcast(loads.select("vslot", F.col("bytes").alias("slot_bytes"))), "vslot").drop("rows", "bytes")
    number = Window.partitionBy("vslot", "part").orderBy("doc_id", "size", "text_crc32")
    numbered = rows.withColumn("at", F.row_number().over(number) - 1)
    return numbered.join(F.broadcast(placed), ["vslot", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("base") + F.col("at")).cast("long").alias("slot"), "grown_shard", "vslot", "slot_bytes", F.col("version").alias("map_version"), "balanced_shard",
    )
