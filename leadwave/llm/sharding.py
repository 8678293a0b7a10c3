"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadwave.llm.common import running_offsets, stash

BUCKET_BYTES = 16 << 20


def shuffle_shards(docs: DataFrame, n_shards: int, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows in a seeded random order, cut into `n_shards` shards whose row counts differ by one at most.

    Pass one scatters rows over buckets by a seeded hash of id and text; a bucket's expected size is `bucket_bytes`, so it
    fits a worker's memory whatever the table's size, and groups of equal texts spread by their ids. Pass two reads each
    bucket, puts it into a canonical order and shuffles it (Fisher-Yates). The rows before a bucket give its place
    in the whole order; shard and slot follow from the place. Rows cross the network once.

    Adds `shard` (int) and `slot` (long, without gaps from 0 in each shard); input columns of these names are replaced.
    Missing ids and texts hash like any value; rows equal in id and text share a bucket and are interchangeable. An empty
    table gives an empty result. Same rows and seed, same result, whatever the partitions.
    """
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = docs.select(*(F.col(f"`{c}`") for c in keep))
    total, n_rows = rows.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8), F.lit(0)), F.count("*")).first()
    n_buckets = max(n_shards, math.ceil(total / bucket_bytes))
    place = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    scattered = rows.withColumns({"__order": place, "__bucket": F.pmod(F.xxhash64(F.lit(seed + 1), place), F.lit(n_buckets))})
    counts = stash(scattered.groupBy("__bucket").agg(F.count("*").alias("__rows")), "buckets")
    starts = running_offsets(counts, "__bucket", "__rows", "__start").select("__bucket", "__start")
    schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def shuffle_bucket(bucket: pa.Table, start: pa.Table) -> pa.Table:
        canonical = pc.sort_indices(bucket, sort_keys=[("__order", "ascending"), ("doc_id", "ascending")]).to_numpy()
        rng = np.random.Generator(np.random.PCG64([seed, start["__bucket"][0].as_py()]))
        order = canonical[rng.permutation(len(canonical))]
        at = start["__start"][0].as_py() + np.arange(len(order), dtype=np.int64)
        shard = at * n_shards // n_rows
        first = -(-shard * n_rows // n_shards)  # the smallest place of that shard
        out = bucket.take(pa.array(order)).select(keep)
        return out.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(at - first))

    return scattered.groupBy("__bucket").cogroup(starts.groupBy("__bucket")).applyInArrow(shuffle_bucket, schema)
