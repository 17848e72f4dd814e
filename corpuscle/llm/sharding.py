"""Sharding: a two-pass external shuffle, with DataFrame functions only.

Pass 1 scatters the records by a seeded hash into buckets of about ``bucket_bytes`` each, so that one task can hold any
bucket. The hash takes in the record's file and place in it, so copies of one record, however many, are scattered as any
other records; records that are not read from files are written first. Pass 2 Fisher-Yates-shuffles each bucket (``shuffle`` of the bucket's sorted records, seeded) and writes it;
a task has one bucket. Buckets follow one another, so a record's place in the whole is its bucket's first place plus its
place in the bucket, and shards are cut from that order at equal counts: law ``rows``, counts at most one apart and slots
without gaps. Records are sorted before they are shuffled, so a task that runs again deals alike. At 100 TB ``bucket_bytes`` is to be 256 MB or more.

Nulls: a null text has no bytes (size 1, the CRC of nothing); null doc_ids and repeated rows are records as any other. A very
long text is one record; its bucket is larger by it. Other columns are kept, whatever their names (but maps, which have no
order); ``shard`` and ``slot`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ._common import documents, numbered, unused, work_dir

BUCKET_BYTES, N_SHARDS, SEED = 32 << 20, 16, 20240229
#: bucket totals of up to so many buckets are sent to all tasks (16 bytes each); beyond it they are joined by a shuffle
BROADCAST_BUCKETS = 1 << 16


def external_shuffle(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = N_SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (input columns of those names are replaced)."""
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    size = F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long") + 1
    total, n = df.agg(F.sum(size), F.count(F.lit(1))).first()
    if not n:
        return df.select(*kept, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    n_buckets = max(1, -(-total // bucket_bytes))
    b, g, c, r = unused(df, 4)
    h = F.xxhash64(F.lit(seed), F.col(key), F.col(text), F.col(r))
    df = numbered(spark, df, r)
    bucket = F.pmod(h, F.lit(n_buckets)).cast("int").alias(b)
    # how many records the buckets before each have
    counts = df.select(bucket).groupBy(b).agg(F.count(F.lit(1)).alias(c))
    if n_buckets <= BROADCAST_BUCKETS:
        firsts, before = [], 0
        for number, k in sorted(tuple(x) for x in counts.collect()):
            firsts.append((number, before))
            before += k
        firsts = F.broadcast(spark.createDataFrame(firsts, "bucket int, first long"))
    else:
        # exact running sums in two levels, so that no task sees all buckets
        group = F.floor(F.col(b) / 4096).alias(g)
        level = counts.groupBy(group).agg(F.sum(c).alias("sum"))
        level = level.select(g, (F.sum("sum").over(W.orderBy(g)) - F.col("sum")).alias("base"))
        own = counts.select(b, c, group).withColumn("inner", F.sum(c).over(W.partitionBy(g).orderBy(b)) - F.col(c))
        firsts = own.join(level, g).select(F.col(b).alias("bucket"), (F.col("base") + F.col("inner")).alias("first"))
    # columns named by place, so that names that clash but for case do not matter
    fields = [f"c{i}" for i in range(len(kept))]
    record = F.struct(h.alias("h"), *[F.col(x).alias(f) for x, f in zip(kept, fields)])
    scattered = df.select(bucket.alias("bucket"), record.alias("r")).repartitionById(n_buckets, "bucket")
    whole = scattered.groupBy("bucket").agg(F.sort_array(F.collect_list("r")).alias("rs")).sortWithinPartitions("bucket")
    dealt = whole.select("bucket", F.posexplode(F.shuffle("rs", seed)).alias("pos", "r")).join(firsts, "bucket")
    dealt = dealt.withColumn("rank", F.col("first") + F.col("pos")).withColumn("shard", F.expr(f"int(rank * {n_shards} div {n})"))
    slot = F.expr(f"rank - (shard * {n} + {n_shards - 1}L) div {n_shards}")
    return dealt.select(*[F.col(f"r.{f}").alias(x) for x, f in zip(kept, fields)], "shard", slot.alias("slot"))


def write_shards(spark: SparkSession, df: DataFrame, path: str | None = None, **options) -> str:
    """Shuffle ``df`` and write a folder of Parquet files per shard, each with its records' slots; returns the path.

    A bucket's records go to one shard, or two at a cut, so a task writes one or two files.
    """
    path = path or work_dir(spark, "shards")
    external_shuffle(spark, df, **options).write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return path


def op2_two_pass_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir).select("doc_id", "text")
    schema = T.StructType([*df.schema.fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    out = spark.read.schema(schema).parquet(write_shards(spark, df))
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    size = (F.octet_length(data) + 1).cast("long").alias("size")
    return out.select("doc_id", size, F.crc32(data).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
