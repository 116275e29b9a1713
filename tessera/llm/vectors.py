"""Blocks of vectors, and the frame in which a stated query set meets all of them.

Each row that can take part lies in exactly one block.  Blocks of data are dealt
to shards by hash; each block of queries is sent to all shards, and the two meet
by an equi-join on the shard.  A task carries the k best of a block of queries
from one block of data to the next, as the bound below which nothing more is
scored.  No table is broadcast or gathered on the driver, and a task holds one
block of data and one of queries at a time, whatever the sizes of both.
"""

from __future__ import annotations

import pickle
from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named

#: Vectors of a data block and of a query block.
BLOCK, QUERIES = 4096, 1024
#: Data blocks of a shard, if there are many, and blocks of queries whose best a task carries along.
SHARD, CARRIED = 64, 256


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Columns id (long) and v (array<double>) of the rows that can take part."""
    v = named(vector).cast("array<double>")
    fits = named(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.where(fits).select(named(key).cast("bigint").alias("id"), v.alias("v"))


def blocked(rows: DataFrame, size: int, build: Callable[[np.ndarray, np.ndarray], object | None]) -> DataFrame:
    """Rows (dim, block): what ``build`` makes of at most ``size`` ids and vectors of one length, pickled."""

    def run(batches):
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count: dict[int, int] = {}

        def made(dim: int, least: int):
            if held.get(dim) and count[dim] >= least:
                ids, vectors = (np.concatenate(x) for x in zip(*held[dim], strict=True))
                while len(ids) >= least and len(ids):
                    block = build(ids[:size], vectors[:size])
                    if block is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([pickle.dumps(block, 5)], pa.binary())], names=["dim", "block"])
                    ids, vectors = ids[size:], vectors[size:]
                held[dim], count[dim] = [(ids, vectors)], len(ids)

        for batch in batches:
            ids, lists = np.asarray(batch.column("id")), batch.column("v")
            lengths = np.asarray(pc.list_value_length(lists))
            for dim in np.unique(lengths).tolist():
                pick = lengths == dim
                own = lists.filter(pa.array(pick))
                held.setdefault(dim, []).append((ids[pick], np.asarray(own.flatten()).reshape(-1, dim)))
                count[dim] = count.get(dim, 0) + int(pick.sum())
                yield from made(dim, size)
        for dim in list(held):
            yield from made(dim, 1)

    return rows.mapInArrow(run, "dim int, block binary")


def search(data: DataFrame, queries: DataFrame, answer: Callable[[object, object, object], tuple], k: int, score_type: str, rows: int) -> DataFrame:
    """The k best of each query over all blocks of ``rows`` rows, by falling score and rising id.

    ``answer(data block, query block, carried)`` gives parallel arrays of query
    ids, data ids and exact scores, at least those of the block that are among a
    query's k best so far, and what is to be carried on (None at first).
    """
    spark = data.sparkSession
    shards = max(8, 2 * spark.sparkContext.defaultParallelism, rows // (BLOCK * SHARD))
    left = data.select("dim", "block", F.pmod(F.xxhash64("block"), F.lit(shards)).alias("shard"))
    asked = queries.select("dim", F.col("block").alias("asked"), F.xxhash64("block").alias("name"))
    right = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))
    arrow = pa.int64() if score_type == "bigint" else pa.float64()

    def run(batches):
        carried: OrderedDict[int, object] = OrderedDict()
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column("name")[i].as_py()
                q, d, s, carried[name] = answer(pickle.loads(batch.column("block")[i].as_buffer()), pickle.loads(batch.column("asked")[i].as_buffer()), carried.pop(name, None))
                if len(carried) > CARRIED:
                    carried.popitem(last=False)
                order = np.argsort(q, kind="stable")
                q, d, s = q[order], d[order], s[order]
                first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
                ends = pa.array(np.r_[first, len(q)].astype(np.int32))
                found = pa.StructArray.from_arrays([pa.array(-s, arrow), pa.array(d, pa.int64())], names=["s", "id"])
                shard = pa.array(np.full(len(first), batch.column("shard")[i].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([shard, pa.array(q[first], pa.int64()), pa.ListArray.from_arrays(ends, found)], names=["shard", "query_id", "found"])

    met = left.join(right, ["dim", "shard"]).select("shard", "block", "asked", "name").mapInArrow(run, f"shard bigint, query_id bigint, found array<struct<s:{score_type},id:bigint>>")
    # First by shard, then over shards, so that no group grows with the number of blocks times k.
    top = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k)
    best = met.groupBy("query_id", "shard").agg(top.alias("found")).groupBy("query_id").agg(top.alias("best"))
    return best.select("query_id", F.posexplode("best")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias("vec_id"), (-F.col("col.s")).alias("score"))
