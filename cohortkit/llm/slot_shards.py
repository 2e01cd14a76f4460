"""Sharding by fixed virtual slots.

Rows hash into a fixed number of slots (thousands). Bytes are summed per slot,
and a small versioned table says which shard holds which slot. Rebalancing
edits that table: slots move as wholes, and no row is hashed anew.

Defined results: a null text counts as empty; a null id hashes like any other
value; repeated rows get places of their own; an empty table gives an empty
result and a valid map; columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortkit.llm.common import stage
from cohortkit.session import scratch_path

N_SLOTS = 4096
#: Slots are cut in so many parts when rows get their places, so no task ranks a whole slot.
PARTS = 8


def with_slots(docs: DataFrame, n_slots: int = N_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, vslot, part): the columns that sharding needs, without the text.

    The slot hash takes the id and the text's checksum, so rows that repeat an
    id with other texts spread over the slots.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
        .select("doc_id", (F.octet_length("_text") + F.lit(8)).cast("long").alias("size"), F.crc32("_text").alias("text_crc32"))
        .withColumn("_h", F.xxhash64("doc_id", "text_crc32"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.pmod("_h", F.lit(n_slots)).cast("int").alias("vslot"),
            F.pmod(F.shiftrightunsigned("_h", 40), F.lit(PARTS)).cast("int").alias("part"),
        )
    )


def slot_bytes(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each slot; at most one row per slot."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 0: slots dealt to shards in turn."""
    return spark.range(n_slots).select(F.col("id").cast("int").alias("vslot"), (F.col("id") % n_shards).cast("int").alias("shard"))


def rebalanced(slot_map: DataFrame, load: DataFrame, n_shards: int) -> DataFrame:
    """Edit ``slot_map`` until the shards' bytes are near equal; (vslot, shard, moved).

    Each shard keeps its largest slots up to the mean load; the others are
    released and go, largest first, to the least loaded shard. All tables here
    have one row per slot, so the fold runs over a bounded array. ``n_shards``
    may exceed the map's shards: new ones start empty.
    """
    sized = slot_map.join(load, "vslot", "left").select("vslot", "shard", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    target = F.sum("bytes").over(W.partitionBy()) / F.lit(n_shards)
    running = F.sum("bytes").over(W.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(W.unboundedPreceding, 0))
    marked = sized.withColumn("_target", target).withColumn("_keep", (F.col("shard") < n_shards) & (running <= F.col("_target")))
    loads = F.transform(
        F.sequence(F.lit(0), F.lit(n_shards - 1)),
        lambda s: F.coalesce(F.element_at(F.col("_held"), s), F.lit(0).cast("long")),
    )
    held = marked.filter("_keep").groupBy("shard").agg(F.sum("bytes").alias("b")).agg(
        F.map_from_entries(F.collect_list(F.struct("shard", "b"))).alias("_held")
    )
    free = marked.filter(~F.col("_keep")).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), F.col("vslot").alias("vslot"), F.col("shard").alias("old")))).alias("_free")
    )

    def place(acc, x):
        to = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        return F.struct(
            F.transform(acc["loads"], lambda v, i: F.when(i == to, v - x["neg"]).otherwise(v)).alias("loads"),
            F.concat(acc["placed"], F.array(to)).alias("placed"),
        )

    start = F.struct(F.col("_loads").alias("loads"), F.array().cast("array<int>").alias("placed"))
    placed = (
        held.crossJoin(free)  # one row each
        .withColumn("_loads", loads)
        .withColumn("_to", F.aggregate("_free", start, place, lambda acc: acc["placed"]))
        .select(F.explode(F.arrays_zip("_free", "_to")).alias("x"))
        .select(F.col("x._free.vslot").alias("vslot"), F.col("x._to").alias("shard"), (F.col("x._to") != F.col("x._free.old")).alias("moved"))
    )
    return marked.filter("_keep").select("vslot", "shard", F.lit(False).alias("moved")).unionByName(placed)


def save_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Store one version; earlier versions stay readable."""
    slot_map.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The given version of the map, or the newest."""
    maps = spark.read.option("basePath", path).parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.filter(F.col("version") == version)


def place(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Add ``shard`` and the row's gapless place ``slot`` in it.

    Rows are ranked inside (slot, part) cells; the start of each cell comes
    from the cells' counts, so no task ever sorts a shard.
    """
    cells = rows.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(slot_map.select("vslot", "shard")), "vslot")
    before = F.sum("n").over(W.partitionBy("shard").orderBy("vslot", "part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    cells = cells.select("vslot", "part", "shard", before.alias("_before"))
    rank = F.row_number().over(W.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size"))
    ranked = rows.withColumn("_rank", rank)
    return ranked.join(cells, ["vslot", "part"]).withColumn("slot", (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_before", "_rank")


def shard_documents(
    docs: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS, map_path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Shard all rows by a freshly balanced map: doc_id, size, text_crc32, vslot, shard, slot, map_version.

    ``map_path`` keeps the versioned map (by default below the shared
    checkpoint folder). An existing map there is rebalanced into a new version.
    """
    spark = docs.sparkSession
    rows = stage(with_slots(docs, n_slots, id_col, text_col), "slot-rows")
    load = slot_bytes(rows)
    if map_path is None:
        map_path, version = scratch_path(spark, "slot-map"), 0
        save_map(first_map(spark, n_shards, n_slots).withColumn("moved", F.lit(False)), map_path, 0)
    else:
        version = load_map(spark, map_path).first()["version"]
    save_map(rebalanced(load_map(spark, map_path, version).select("vslot", "shard"), load, n_shards), map_path, version + 1)
    newest = load_map(spark, map_path, version + 1)
    return place(rows, newest).withColumn("map_version", F.lit(version + 1))
