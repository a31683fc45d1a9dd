"""Cards from a folder that grows: the batch operators over a stream of files. An addition of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import cards as S
from ..sources import png

#: The columns of Spark's source of whole files, which a stream must be told.
FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_cards(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming DataFrame of path, card and error for each PNG file that appears in `folder`."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.png").load(folder)
    return S.parse(png.with_chunks(files))


def spec_counts(stream: DataFrame) -> DataFrame:
    """Running counts by version; files without a card count as failures."""
    return stream.groupBy(F.coalesce("card.spec_version", F.lit("failure")).alias("spec_version")).agg(F.count("*").alias("cards"))
