"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters the records into memory-sized buckets by a seeded hash. Pass two shuffles each bucket by Fisher-Yates
(`pyspark.sql.functions.shuffle`) and numbers it on from the buckets before it; shards deal out that one random order.

A bucket is a partition of its own, and its number is the partition's. `shuffle` starts its generator from the seed and that
number, so a bucket's order does not depend on how partitions fall to tasks, and a task holds one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import free_name, quoted, stored

#: Bytes of text that a bucket holds on average; a task shuffles one bucket in memory.
BUCKET_BYTES = 8 << 20
#: Most buckets. From 1.6 TB on buckets grow instead: at 100 TB they hold 500 MB.
MOST_BUCKETS = 200_000
#: Times the average from which on a bucket is looked through for rows that are alike.
HEAVY = 4
#: Buckets that one task numbers together.
SPAN = 4096


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def bucket_starts(counts: DataFrame) -> DataFrame:
    """(bucket, start): rows in the buckets before each, summed in spans of SPAN and then over the spans' totals."""
    spans = counts.withColumn("span", F.expr(f"bucket div {SPAN}"))
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    totals = spans.groupBy("span").agg(F.sum("n").alias("total")).select("span", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("span").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(totals, "span").select("bucket", (F.col("base") + F.col("within")).alias("start"))


def _scattered(docs: DataFrame, record: Column, n_buckets: int, bucket_bytes: int, seed: int, identity: list[Column], size: Column) -> DataFrame:
    """(bucket, draw, record). Rows go by the hash of their id and text. Rows alike in both that are more than a bucket's
    worth are written once with numbers and go by those, so that they fill many buckets."""
    bucket, draw = F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(n_buckets)).cast("int"), F.xxhash64(F.lit(seed + 1), *identity)
    sized = docs.select(bucket.alias("bucket"), draw.alias("draw"), size.alias("size"))
    heavy = sized.groupBy("bucket").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > HEAVY * bucket_bytes).select("bucket")
    rows = docs.select(bucket.alias("bucket"), draw.alias("draw"), record.alias("record"))
    if heavy.isEmpty():
        return rows
    inside = sized.join(F.broadcast(heavy), "bucket", "left_semi")  # at most total / (HEAVY * bucket_bytes) buckets
    hot = stored(inside.groupBy("bucket", "draw").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where((F.col("n") > 1) & (F.col("bytes") > bucket_bytes)).select("draw"), "alike")
    if hot.isEmpty():
        return rows
    numbered = stored(rows.join(F.broadcast(hot), "draw", "left_semi").withColumn("number", F.monotonically_increasing_id()), "numbered")
    by_number = numbered.select(F.pmod(F.xxhash64(F.lit(seed), "number"), F.lit(n_buckets)).cast("int").alias("bucket"), F.xxhash64(F.lit(seed + 1), "number").alias("draw"), "record")
    return rows.join(F.broadcast(hot), "draw", "left_anti").select("bucket", "draw", "record").unionByName(by_number)


def shard(docs: DataFrame, n_shards: int = 8, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with two more columns: shard int (0 to n_shards - 1) and slot long (gapless from 0 in each shard).

    Law `rows`: the shards' row counts are at most one apart. Every row gets a place, repeated rows, null ids and
    null or empty texts too; existing columns named shard or slot are replaced. An empty table gives no rows. The order
    is random but fixed by the seed and the rows' ids and texts, whatever the partitions; rows alike in both may trade
    places, and where they are more than a bucket's worth (bucket_bytes) the order also follows the input's partitions.
    """
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("shard", "slot")])
    text = F.col(f"`{text_col}`")
    identity = [F.col(f"`{id_col}`").cast("string"), text]
    total = docs.agg(F.sum(text_size(text))).first()[0] or 0
    n_buckets = min(MOST_BUCKETS, max(1, -(-total // bucket_bytes)))
    record = F.struct(*[c.alias(n) for c, n in zip(quoted(kept.columns), kept.columns, strict=True)])
    scattered = _scattered(docs, record, n_buckets, max(bucket_bytes, total // n_buckets), seed, identity, text_size(text))
    counts = scattered.groupBy("bucket").agg(F.count("*").alias("n"))
    # One order before the draw whatever order the shuffle delivered: a task that runs again gives the same places.
    gathered = scattered.repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("bucket", "draw").groupBy("bucket").agg(F.collect_list("record").alias("records"))
    drawn = gathered.select("bucket", F.shuffle("records", F.lit(seed)).alias("records"))
    placed = drawn.join(F.broadcast(bucket_starts(counts)), "bucket")  # MOST_BUCKETS rows at most
    rows = placed.select("start", F.posexplode("records").alias("at", "record"))
    place = F.col("start") + F.col("at")
    return rows.select("record.*", F.pmod(place, F.lit(n_shards)).cast("int").alias("shard"), F.expr(f"(start + at) div {int(n_shards)}").alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, seed: int = 20, **names: str) -> None:
    """Writes the shards as Parquet folders shard=0, 1, ...; each row keeps its slot, which gives the order on reading."""
    placed = shard(docs, n_shards, seed, **names)
    part = free_name(placed, "part")
    # A shard is written by as many tasks as its slots fill, not by one.
    placed.withColumn(part, F.expr("slot div 100000")).repartition("shard", part).sortWithinPartitions("shard", "slot").drop(part).write.partitionBy("shard").parquet(path)
