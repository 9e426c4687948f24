"""Sizes of diagram images from their headers, and their checks. Pixels are not decoded."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Sides of an image in pixels.
LEAST_SIDE, LARGEST_SIDE = 10, 20000
FORMATS = ("jpg", "jpeg", "png", "bmp", "tiff", "tif", "webp", "gif")


def header(data: bytes | None) -> tuple[str | None, int | None, int | None]:
    """(format, width, height) that the first bytes of an image state; nulls where they are unknown or cut off."""
    try:
        if not data:
            return None, None, None
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return "png", *struct.unpack(">II", data[16:24])
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return "gif", *struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            width, height = struct.unpack("<ii", data[18:26])
            return "bmp", width, abs(height)  # negative for rows from the top
        if data[:2] == b"\xff\xd8":
            at = 2
            while data[at] == 0xFF:
                kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame's header
                    height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                    return "jpeg", width, height
                at += 2 + size
    except (struct.error, IndexError):
        pass
    return None, None, None


HEADER = StructType([StructField("format", StringType()), StructField("width", IntegerType()), StructField("height", IntegerType())])


@F.pandas_udf(HEADER)
def read_header(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([header(c) for c in content], columns=["format", "width", "height"]).astype({"width": "Int32", "height": "Int32"})


def size_problem(width: Column, height: Column) -> Column:
    """Why an image of this size is refused, else null."""
    low, high = F.least(width, height), F.greatest(width, height)
    return F.when(low.isNull(), "unreadable").when(low == 0, "zero dimension").when(low < LEAST_SIDE, "too small").when(high > LARGEST_SIDE, "too large")


def checked(images: DataFrame) -> DataFrame:
    """images (path, content) -> path, format, width, height, problem."""
    rows = images.select("path", read_header("content").alias("h")).select("path", "h.*")
    return rows.withColumn("problem", size_problem(F.col("width"), F.col("height")))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """checked() for all image files below a folder."""
    pattern = f"*.{{{','.join([*FORMATS, *map(str.upper, FORMATS)])}}}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return checked(files.select("path", "content"))
