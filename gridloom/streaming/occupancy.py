"""Occupancy maps from streams.

A map is the fold of its updates in the order of the rays, so a stream keeps, for each
voxel and run of rays, the map of values that the run's updates make (see operators/runs):
each micro-batch appends these rows to a table, partitioned by batch, and the map is put
together from it. Appending is idempotent a batch: a batch that runs again overwrites its
own partition. Batches may come in any order, if each holds a range of seq of its own; a
late batch takes the place that its seq gives it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridloom.functions.params import MapParams
from gridloom.functions import shared
from gridloom.operators import runs


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a local one only in local mode, as in tests."""
    base = shared.base(spark)
    return f"{base}/stream-{uuid.uuid4().hex}"


def append_runs(rays: DataFrame, folder: str, p: MapParams, checkpoint: str):
    """A query that reduces each micro-batch of rays to its runs and appends them."""

    def write(batch: DataFrame, number: int) -> None:
        runs.runs_of(batch, p).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rays.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(spark: SparkSession, sf_dir: str, p: MapParams = MapParams()) -> DataFrame:
    """The rays of the events table as a stream of files, then the map of all batches."""
    from gridloom.sources.rays import RAY_COLUMNS

    folder = shared_folder(spark)
    # a stream reads folders of files: the events are dealt to files first
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartitionByRange(4, "event_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    rays = stream.selectExpr(*[f"{e} AS {n}" for n, e in RAY_COLUMNS.items()])
    query = append_runs(rays, f"{folder}/runs", p, f"{folder}/state")
    query.awaitTermination()
    return runs.put_together(spark.read.parquet(f"{folder}/runs"), p)
