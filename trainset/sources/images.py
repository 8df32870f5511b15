"""Image files and tables with embedded images. Pixels are never decoded: sizes come from headers."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

IMAGE_GLOB = "*.{png,jpg,jpeg,webp,bmp,PNG,JPG,JPEG,WEBP,BMP}"
SIZE = T.StructType(
    [T.StructField("format", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]
)


def header_size(data: bytes | None) -> tuple[str, int, int] | None:
    """(format, width, height) from the first bytes of PNG, GIF, BMP, WebP or JPEG data."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return ("png", *struct.unpack(">II", data[16:24]))
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return ("gif", *struct.unpack("<HH", data[6:10]))
        if data[:2] == b"BM":
            w, h = struct.unpack("<ii", data[18:26])
            return ("bmp", w, abs(h))
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            if data[12:16] == b"VP8X":
                return ("webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"))
            if data[12:16] == b"VP8 ":
                w, h = struct.unpack("<HH", data[26:30])
                return ("webp", w & 0x3FFF, h & 0x3FFF)
            bits = int.from_bytes(data[21:25], "little")
            return ("webp", 1 + (bits & 0x3FFF), 1 + ((bits >> 14) & 0x3FFF))
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data):
                if data[at] != 0xFF:
                    return None
                marker, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return ("jpeg", w, h)
                at += 2 + length
    except (struct.error, TypeError, IndexError):
        return None
    return None


@F.pandas_udf(SIZE)
def image_size(content: pd.Series) -> pd.DataFrame:
    sizes = [header_size(c) or (None, None, None) for c in content]
    out = pd.DataFrame(sizes, columns=["format", "width", "height"])
    return out.astype({"width": "Int32", "height": "Int32"})


def read_image_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content, length) of the image files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", IMAGE_GLOB).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content", "length")


def read_image_table(df: DataFrame, image: str, caption: str | None = None, key: str = "seq") -> DataFrame:
    """Rows with an image column (binary or ``struct<bytes, path>``) in the shape of image files."""
    kind = df.schema[image].dataType.typeName()
    content = F.col(f"{image}.bytes") if kind == "struct" else F.col(image)
    name = F.col(f"{image}.path") if kind == "struct" else F.lit(None).cast("string")
    return df.select(
        F.col(key).cast("string").alias("path"), name.alias("name"), content.alias("content"),
        F.octet_length(content).cast("long").alias("length"),
        (F.coalesce(F.col(caption).cast("string"), F.lit("")) if caption else F.lit("")).alias("caption"),
    )
