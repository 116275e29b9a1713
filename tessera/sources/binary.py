"""Binary interchange of points, polygons and results (little-endian).

Formats, as fixed by the readers of such files:
points: int32 worker, int32 count, int32 mode, 4 bytes unused, float64 stripe
start and end, then count * (float64 x, float64 y, uint64 id);
polygons: uint64 n, then n * (uint64 id, ring, uint64 holes, rings), a ring
being uint64 count and count * (float64 x, float64 y, uint64 0);
results: int64 points, matched, unmatched, candidates and uint64 checksum.

Payloads are rows with a binary column, so a table is written and read in
parallel; ``read_files`` takes whole files as payloads.  Short payloads raise.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import POINTS, POLYGONS

HEADER, HEADER_SIZE = "<iii4xdd", 32
RESULT = "<qqqqQ"
POINT = np.dtype([("x", "<f8"), ("y", "<f8"), ("id", "<u8")])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows (path, payload)."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("payload"))


def encode_points(points: DataFrame, stripe: str, bounds: tuple[float, float], mode: int = 0, chunk: int = 100_000) -> DataFrame:
    """Rows stripe, points, payload; a stripe makes payloads of at most ``chunk`` points."""

    def run(batches):
        for batch in batches:
            which = np.asarray(batch.column("stripe"))
            for s in np.unique(which):
                own = np.flatnonzero(which == s)
                for a in range(0, len(own), chunk):
                    part = own[a : a + chunk]
                    rows = np.zeros(len(part), POINT)
                    for name, column in (("x", "x"), ("y", "y"), ("id", "point_id")):
                        rows[name] = np.asarray(batch.column(column))[part]
                    payload = struct.pack(HEADER, int(s), len(part), mode, *bounds) + rows.tobytes()
                    yield pa.RecordBatch.from_pydict({"stripe": pa.array([int(s)], pa.int32()), "points": pa.array([len(part)], pa.int64()), "payload": pa.array([payload], pa.binary())})

    return points.select(F.col(stripe).cast("int").alias("stripe"), "point_id", "x", "y").mapInArrow(run, "stripe int, points bigint, payload binary")


def decode_points(payloads: DataFrame) -> DataFrame:
    """Points of payloads."""

    def run(batches):
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                _, count, *_ = struct.unpack_from(HEADER, payload)
                rows = np.frombuffer(payload, POINT, count, HEADER_SIZE)
                yield pa.RecordBatch.from_arrays([pa.array(rows["id"].astype(np.int64)), pa.array(rows["x"].copy()), pa.array(rows["y"].copy())], names=["point_id", "x", "y"])

    return payloads.select("payload").mapInArrow(run, POINTS)


def _ring(vertices: list[dict]) -> bytes:
    rows = np.zeros(len(vertices), POINT)
    rows["x"], rows["y"] = [v["x"] for v in vertices], [v["y"] for v in vertices]
    return struct.pack("<Q", len(vertices)) + rows.tobytes()


def encode_polygons(polygons: DataFrame) -> DataFrame:
    """Rows polygons, payload: one payload for each Arrow batch; each part is a polygon."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            body = b"".join(struct.pack("<Q", r["polygon_id"] & (1 << 64) - 1) + _ring(r["exterior"]) + struct.pack("<Q", len(r["holes"])) + b"".join(map(_ring, r["holes"])) for r in rows)
            yield pa.RecordBatch.from_pydict({"polygons": pa.array([len(rows)], pa.int64()), "payload": pa.array([struct.pack("<Q", len(rows)) + body], pa.binary())})

    return polygons.select("polygon_id", "exterior", "holes").mapInArrow(run, "polygons bigint, payload binary")


def decode_polygons(payloads: DataFrame) -> DataFrame:
    """Polygons of payloads, each of one part."""
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    def parse(payload: bytes) -> list[dict]:
        at = 0

        def number() -> int:
            nonlocal at
            at += 8
            return struct.unpack_from("<Q", payload, at - 8)[0]

        def ring() -> list[dict]:
            nonlocal at
            rows = np.frombuffer(payload, POINT, number(), at)
            at += rows.nbytes
            return [{"x": float(r["x"]), "y": float(r["y"])} for r in rows]

        out = []
        for _ in range(number()):
            key = number()
            outer = ring()
            out.append({"polygon_id": key - (1 << 64) if key >> 63 else key, "exterior": outer, "holes": [ring() for _ in range(number())]})
        return out

    def run(batches):
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                rows = parse(payload)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["polygon_id"] for r in rows], pa.int64()), pa.array([0] * len(rows), pa.int32()), pa.array([r["exterior"] for r in rows], kind), pa.array([r["holes"] for r in rows], pa.list_(kind))],
                        names=["polygon_id", "part_no", "exterior", "holes"],
                    )

    return payloads.select("payload").mapInArrow(run, POLYGONS)


def encode_results(results: DataFrame) -> DataFrame:
    """Rows stripe, payload from stripe, points, matched, unmatched, candidates and checksum (hex)."""

    @F.udf("binary")
    def pack(points: int, matched: int, unmatched: int, candidates: int, checksum: str) -> bytes:
        return struct.pack(RESULT, points, matched, unmatched, candidates, int(checksum, 16))

    return results.select("stripe", pack("points", "matched", "unmatched", "candidates", "checksum").alias("payload"))


def decode_results(payloads: DataFrame) -> DataFrame:
    """Inverse of ``encode_results``; one row for each worker, so a row-wise function will do."""

    @F.udf("struct<points:bigint,matched:bigint,unmatched:bigint,candidates:bigint,checksum:string>")
    def unpack(payload: bytes) -> tuple:
        *counts, checksum = struct.unpack(RESULT, bytes(payload))
        return (*counts, format(checksum, "x"))

    return payloads.select("stripe", unpack("payload").alias("r")).select("stripe", "r.*")
