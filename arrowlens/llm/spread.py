"""Even work for heavy per-document functions."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(docs: DataFrame) -> DataFrame:
    """The same rows, dealt out round robin if they lie in fewer pieces than the cluster has cores (a few large files);
    otherwise as they lie, without a shuffle."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)
