"""Classification of points that arrive in files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.aggregate import merged, partials
from tessera.operators.join import classify


def classify_stream(stream: DataFrame, polygons: DataFrame, **options) -> DataFrame:
    """A stateless map of a stream of points: no watermark or state is needed, as points have no time."""
    return classify(stream, polygons, strategy="cells", **options)


def summarise_files(spark: SparkSession, glob: str, schema, to_points, polygons: DataFrame, folder: str, files_per_batch: int = 1, **options) -> DataFrame:
    """Classifies files in micro-batches and merges the batches' aggregates.

    A batch writes its partial aggregate under its number, so a batch that runs
    again replaces its own; ``folder`` must be shared by all executors.
    """
    base = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def each(batch: DataFrame, number: int) -> None:
        partials(classify(to_points(batch), polygons, **options)).coalesce(1).write.mode("overwrite").parquet(f"{base}/batches/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(glob)
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return merged(spark.read.parquet(f"{base}/batches"))
