"""Lines, pixels and nodes out of ordinary tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(df: DataFrame, line_id: str, order: list[str], value) -> DataFrame:
    """line_id, x (0, 1, … in a total order), i."""
    w = Window.partitionBy("line_id").orderBy(*[f"o{k}" for k in range(len(order))])
    named = df.select(F.col(line_id).cast("long").alias("line_id"), *(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), value.cast("long").alias("i"))
    return named.withColumn("x", (F.row_number().over(w) - 1).cast("long")).select("line_id", "x", "i")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line a user: rounded values in order of time."""
    return lines(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.round("value"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line a customer: thousands of the order's price in order of date."""
    return lines(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], F.floor(F.col("o_totalprice") / 1000))


def vector_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line a vector: floor(128 v + 128) by place, as a row of embedding_frames."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("line_id"), F.posexplode("embedding").alias("x", "v"))
    return e.select("line_id", F.col("x").cast("long").alias("x"), F.floor(F.col("v").cast("double") * 128 + 128).cast("long").alias("i"))


def embedding_frames(spark: SparkSession, sf_dir: str, side: int = 64) -> DataFrame:
    """Square frames of ``side`` vectors, one a row; i = floor(128 v + 128)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    return e.select(
        F.floor(F.col("vec_id") / side).cast("long").alias("frame_id"),
        F.pmod(F.col("vec_id"), F.lit(side)).cast("int").alias("y"),
        F.col("x").cast("int").alias("x"),
        F.floor(F.col("v").cast("double") * 128 + 128).cast("long").alias("i"),
    )


def rows_between(pixels: DataFrame, first: int, last: int) -> DataFrame:
    """Rows first … last - 1 of every frame."""
    return pixels.where(f"y >= {first} and y < {last}")


def tile(pixels: DataFrame, y: int, x: int, height: int, width: int) -> DataFrame:
    """A crop of every frame, with its own coordinates kept."""
    return pixels.where(f"y >= {y} and y < {y + height} and x >= {x} and x < {x + width}")


def spliced(pixels: DataFrame) -> DataFrame:
    """All rows of a frame as one line, row after row."""
    w = Window.partitionBy("frame_id").orderBy("y", "x")
    return pixels.select(F.col("frame_id").alias("line_id"), (F.row_number().over(w) - 1).cast("long").alias("x"), "i")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of the images Spark's image source can read: mean over the channels."""
    raw = spark.read.format("image").load(path).select(F.xxhash64("image.origin").alias("frame_id"), "image.height", "image.width", "image.nChannels", "image.data")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for frame, height, width, n, data in zip(*(c.to_pylist() for c in b.columns)):
                if n <= 0:  # not an image
                    continue
                value = np.frombuffer(data, np.uint8).reshape(height * width, n).mean(1)
                for at in range(0, len(value), 1 << 20):
                    part = np.arange(at, min(len(value), at + (1 << 20)))
                    columns = [np.full(len(part), frame), (part // width).astype(np.int32), (part % width).astype(np.int32), value[part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["frame_id", "y", "x", "i"])

    return raw.mapInArrow(decode, "frame_id long, y int, x int, i double")
