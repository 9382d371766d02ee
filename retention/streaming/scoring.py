"""Scoring a stream of customer records with Structured Streaming.

The reference scores requests one at a time; scoring is stateless, so the same
projection chain used for batches (clean -> engineer -> encode -> score) applies to
a streaming DataFrame unchanged. The sink is Spark's parquet file sink, whose log makes each
epoch count once, or a memory table for tests. The checkpoint location is required with a file sink: a
restart must find its offsets in the same folder. ``max_files`` only paces the trigger; it drops nothing.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..operators import encode as EN
from ..operators import score as SC
from ..session import ensure_checkpoint_dir
from ..sources.files import RAW_SCHEMA


def read_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int = 100) -> DataFrame:
    reader = spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def score_stream(stream: DataFrame, median: float | None, encoder: EN.EncoderState,
                 scorer: SC.LinearScorer) -> DataFrame:
    feats = SC.features_for_scoring(stream, median, encoder)
    return SC.score(feats, scorer)


def start(scored: DataFrame, output: str | None = None, query_name: str = "scored",
          checkpoint: str | None = None, trigger_once: bool = True):
    spark = scored.sparkSession
    if output is not None and checkpoint is None:
        raise ValueError("a file sink needs a checkpoint folder that outlives the application")
    ckpt = checkpoint or os.path.join(ensure_checkpoint_dir(spark), f"stream-{query_name}")
    w = scored.writeStream.option("checkpointLocation", ckpt).queryName(query_name)
    w = w.trigger(availableNow=True) if trigger_once else w
    if output is None:
        return w.format("memory").outputMode("append").start()
    return w.format("parquet").outputMode("append").start(output)
