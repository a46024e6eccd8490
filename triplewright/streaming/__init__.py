"""The same parsers over files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from triplewright.sources.lines import parse_triples


def stream_triples(spark: SparkSession, folder: str) -> DataFrame:
    """Triples of every text file that appears in ``folder``; stateless, so it runs in append mode without a watermark."""
    return parse_triples(spark.readStream.text(folder))
