"""Stream scoring (L7 on a stream): the batch ``PipelineModel`` applied to ``readStream``.

Stateless: each micro-batch is scaled, predicted and graded exactly as a
batch would be; the checkpoint lives under the session's shared
``spark.checkpoint.dir`` so a restarted query resumes where it stopped.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.score import grade
from ..session import ensure_checkpoint_dir


def score_stream(spark: SparkSession, model: PipelineModel, source: str, schema: T.StructType, fmt: str = "parquet",
                 max_files: int = 1) -> DataFrame:
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(source)
    return model.transform(stream).withColumn("grade", grade("prediction"))


def run_to_table(scored: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """Drain the available input into Parquet files of the shared folder (trigger availableNow) and return that table."""
    spark = scored.sparkSession
    base = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    q = (scored.writeStream.format("parquet").queryName(name).outputMode("append").option("path", f"{base}/rows")
         .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(scored.schema).parquet(f"{base}/rows")
