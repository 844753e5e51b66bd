"""Sharding by fixed virtual slots: records hash into slots, bytes are summed by slot, and a stored, versioned map deals slots to shards.

A record's slot depends on its text alone and never changes, so equal texts share a slot and so a shard. The map has an entry
for each slot, from its first version on; the few texts that outweigh LARGE of an even share have an entry of their own in their
slot, and one that outweighs a whole share, which no shard could hold, has PARTS entries, into which its copies fall by id (those of one
id that is as heavy, by the partition that they are read in). So the map is a table of bounded size whatever the data: SLOTS entries,
and for each run fewer than shards / LARGE + shards * PARTS more. It may be sorted in one place and broadcast.

The first version deals slots evenly without looking at the data. Rebalancing reads the last one back, edits it by the bytes that were
measured, and stores the next version; entries that the new records don't touch are carried on. An entry stays on
its shard as long as that keeps within the tolerance of an even share. A row's place in its shard is a prefix sum over hash units of
even size; rows that are alike are parted by where they are read, so neither a shard nor a group of copies is ever one task.
"""

from __future__ import annotations

import math
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkquill.llm.common import cut, shared_folder

SLOTS = 4_096
#: The part of an even share from which a text has an entry of its own, and the entries of a text that outweighs a share.
LARGE, PARTS = 1 / 16, 256
#: What names an entry: digest and part are null but for large texts.
ENTRY = ("vslot", "digest", "part")


def slot_rows(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, digest, vslot) for each row of docs (doc_id, text): its bytes and one, and its virtual slot."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("digest"))
    return rows.withColumn("vslot", F.pmod("digest", F.lit(slots)).cast("int"))


def held(slot_map: DataFrame) -> int:
    """The bytes that a map counts."""
    return slot_map.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]


def large_texts(rows: DataFrame, shards: int, total: int = 0) -> DataFrame:
    """(digest, parts, share) of the texts that have entries of their own: parts is null for one entry. total: bytes that the shards hold already, if
    those are more than the rows' own. Only slots that are that heavy are looked into."""
    sums = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"))
    heavy = sums.withColumn("share", F.greatest(F.sum("bytes").over(Window.partitionBy()), F.lit(total)) / shards).where(F.col("bytes") > F.col("share") * LARGE)
    texts = rows.join(F.broadcast(heavy.select("vslot", "share")), "vslot").groupBy("digest", "share").agg(F.sum("size").alias("bytes"))
    return texts.where(F.col("bytes") > F.col("share") * LARGE).select("digest", F.when(F.col("bytes") > F.col("share"), PARTS).alias("parts"), "share")


def crowded_ids(rows: DataFrame, large: DataFrame) -> DataFrame:
    """(digest, doc_id) of copies of a text in parts that share an id and outweigh LARGE of a share themselves."""
    copies = rows.join(F.broadcast(large.where("parts IS NOT NULL").select("digest", "share")), "digest").groupBy("digest", "doc_id", "share").agg(F.sum("size").alias("bytes"))
    return copies.where(F.col("bytes") > F.col("share") * LARGE).select("digest", "doc_id")


def with_entries(rows: DataFrame, large: DataFrame, crowded: DataFrame) -> DataFrame:
    """slot_rows with the entry of the map that holds for each row: digest becomes null but for large texts, and part is added."""
    named = large.select(F.col("digest").alias("__digest"), "parts")
    ids = crowded.select(F.col("digest").alias("__own"), F.col("doc_id").alias("__id"))
    found = rows.join(F.broadcast(named), F.col("digest") == F.col("__digest"), "left")
    found = found.join(F.broadcast(ids), (F.col("digest") == F.col("__own")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    spread = F.when(F.col("__own").isNotNull(), F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long"))
    part = F.pmod(F.xxhash64("doc_id", "digest", spread), F.col("parts")).cast("int")
    return found.withColumn("part", part).withColumn("digest", F.col("__digest")).drop("__digest", "parts", "__own", "__id")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """(vslot, digest, part, shard, bytes): every slot, dealt round about before anything is known of the data."""
    vslot = F.col("id").cast("int")
    return spark.range(slots).coalesce(1).select(vslot.alias("vslot"), F.lit(None).cast("long").alias("digest"), F.lit(None).cast("int").alias("part"), F.pmod(vslot, F.lit(shards)).cast("int").alias("shard"), F.lit(0).cast("long").alias("bytes"))


def merged(entries: DataFrame, previous: DataFrame, shards: int, further: bool = False) -> DataFrame:
    """(vslot, digest, part, bytes, old): all entries of the previous map and of these. bytes: what these have (and further: what the map has
    too), else what the map has; old: the shard that an entry was on, for a text that leaves its slot that of the slot. A slot that held
    nothing, beside others that did, has nothing to move and no old shard."""
    filled = held(previous) > 0
    slots = previous.where("digest IS NULL").select(F.col("vslot").alias("__slot"), F.col("shard").alias("__at"))
    both = previous.select(*ENTRY, F.col("bytes").alias("had"), "shard").unionByName(entries.select(*ENTRY, "bytes"), allowMissingColumns=True)
    found = both.groupBy(*ENTRY).agg(F.sum("bytes").alias("new"), F.sum("had").alias("had"), F.max("shard").alias("old"))
    found = found.join(F.broadcast(slots), F.col("vslot") == F.col("__slot"), "left")
    bytes_ = F.coalesce(F.col("new") + F.coalesce("had", F.lit(0)), "had") if further else F.coalesce("new", "had")
    old = F.coalesce("old", F.pmod(F.col("__at") + F.coalesce("part", F.lit(0)), F.lit(shards))).cast("int")
    return found.select(*ENTRY, bytes_.cast("long").alias("bytes"), (F.when(~F.coalesce(F.col("had") == 0, F.lit(False)), old) if filled else old).alias("old"))


def rebalance(entries: DataFrame, shards: int, previous: DataFrame, tolerance: float = 0.005, further: bool = False) -> DataFrame:
    """The next map: the previous one with entries (vslot, digest, part, bytes) merged into it, heaviest first onto the lightest shard.

    Entries keep the shard of the previous map where that stays within (1 + tolerance) of an even share; those that it
    doesn't have are new, shards beyond those it names start empty. None is lost.
    """
    known = merged(entries, previous, shards, further)
    entry = F.struct((-F.col("bytes")).alias("less"), *ENTRY, "old")
    whole = known.agg(F.array_sort(F.collect_list(entry)).alias("slots"), F.sum("bytes").alias("total"))
    limit = F.col("total") * ((1 + tolerance) / shards)

    def place(state, slot):
        loads = state["loads"]
        lightest = (F.array_position(loads, F.array_min(loads)) - 1).cast("int")
        stays = slot["old"].isNotNull() & (slot["old"] < shards)
        stays = stays & (F.get(loads, F.when(stays, slot["old"]).otherwise(0)) - slot["less"] <= limit)
        shard = F.when(stays, slot["old"]).otherwise(lightest)
        return F.struct(F.transform(loads, lambda x, i: x - F.when(i == shard, slot["less"]).otherwise(0)).alias("loads"), F.concat(state["dealt"], F.array(shard)).alias("dealt"))

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("dealt"))
    dealt = whole.select(F.explode(F.arrays_zip("slots", F.aggregate("slots", start, place)["dealt"].alias("dealt"))).alias("x"))
    return dealt.select(*[F.col(f"x.slots.{c}").alias(c) for c in ENTRY], F.col("x.dealt").alias("shard"), (-F.col("x.slots.less")).alias("bytes"))


def save_map(slot_map: DataFrame, path: str, version: int) -> None:
    """Adds a version to the maps in path; one that is there already is an error."""
    slot_map.write.parquet(f"{path.rstrip('/')}/version={version}")


def latest_version(spark: SparkSession, path: str) -> int:
    """0 if the folder holds no map, or doesn't exist."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in system.listStatus(folder)] if system.exists(folder) else []
    return max((int(n.removeprefix("version=")) for n in names if n.startswith("version=")), default=0)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/version={version}").withColumn("version", F.lit(version))


def shard_rows(docs: DataFrame, shards: int = 8, slots: int = SLOTS, unit_rows: int = 2_000, path: str | None = None, further: bool = False) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, size, text_crc32, law (``bytes``), shard, slot (its place in the shard,
    from 0 without gaps), grown_shard (null: the law isn't ``key``), vslot, version.

    Shards come from the maps in path (a new folder in the shared one, unless given): the latest one is edited by the bytes of
    these docs, stored as the next version and read back; an empty folder gets a first version to start from. Entries that these docs touch
    are measured anew, or further: these docs are added to what the map counts; the others are carried on. Places count these docs alone. Null text counts
    as empty: no bytes, crc32 of nothing. Repeated rows stand apart. Further columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/shard-map-{uuid4().hex}"
    version = latest_version(spark, path)
    if not version:
        save_map(first_map(spark, shards, slots), path, version := 1)
    before = load_map(spark, path, version)
    rows = cut(slot_rows(docs, slots))
    large = large_texts(rows, shards, held(before))
    crowded = crowded_ids(rows, large)
    kept = before.where("digest IS NOT NULL").groupBy("digest").agg(F.when(F.max("part").isNotNull(), PARTS).alias("parts"))
    large = kept.unionByName(large.select("digest", "parts")).groupBy("digest").agg(F.max("parts").alias("parts"))
    rows = cut(with_entries(rows, large, crowded))
    entries = cut(rows.groupBy(*ENTRY).agg(F.sum("size").alias("bytes")))
    save_map(rebalance(entries, shards, before, further=further), path, version + 1)
    slot_map = load_map(spark, path, version + 1).select(*[F.col(c).alias(f"map_{c}") for c in ENTRY], "shard", "version")
    units = max(1, math.ceil(rows.count() / shards / unit_rows))
    # The partition of a stored row is fixed, so copies that are alike have units of their own in each.
    rows = rows.withColumn("unit", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.spark_partition_id()), F.lit(units)))
    placed = rows.join(F.broadcast(slot_map), [F.col(c).eqNullSafe(F.col(f"map_{c}")) for c in ENTRY])
    counts = placed.groupBy("shard", "unit").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "unit", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "unit").orderBy("doc_id", "text_crc32", "size"))
    placed = placed.withColumn("own", within).join(counts, ["shard", "unit"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), (F.col("before") + F.col("own") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", "version")
