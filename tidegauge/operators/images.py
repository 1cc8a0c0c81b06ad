"""Which images are kept: statistics of pixels in Python, decisions as a table. Nothing is deleted."""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

_GAP = rb"(?:\s|#[^\n]*\n)+"
_PIXMAP = re.compile(rb"(P[56])" + _GAP + rb"(\d+)" + _GAP + rb"(\d+)" + _GAP + rb"(\d+)\s")
DARK, BRIGHT, KINDS, ZEROS = 25, 240, 3, 0.05 * 512 * 512


def decode(content: bytes) -> np.ndarray | None:
    """Pixels of an image: portable pixmaps and saved arrays here, other formats where an imaging library is installed; None if unreadable."""
    try:
        head = _PIXMAP.match(content)
        if head:
            width, height, top = (int(head[k]) for k in (2, 3, 4))
            n = width * height * (3 if head[1] == b"P6" else 1)
            pixels = np.frombuffer(content[head.end() :], np.uint8)
            return pixels.reshape(height, width, -1) if top < 256 and len(pixels) == n else None
        if content[:6] == b"\x93NUMPY":
            return np.load(io.BytesIO(content), allow_pickle=False)
        from PIL import Image  # not always there

        return np.array(Image.open(io.BytesIO(content)))
    except Exception:  # noqa: BLE001
        return None


def _statistics(reader: Callable[[bytes], np.ndarray | None]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for content in batch["content"]:
                pixels = reader(bytes(content)) if content is not None else None
                if pixels is None or pixels.size == 0:
                    rows.append((None, None, None))
                else:
                    rows.append((float(pixels.mean()), int(len(np.unique(pixels))), int((pixels == 0).sum())))
            mean, kinds, zeros = zip(*rows) if rows else ((), (), ())
            yield batch.drop(columns="content").assign(mean=pd.Series(mean, dtype="float64", index=batch.index), kinds=pd.array(kinds, dtype="Int64"), zeros=pd.array(zeros, dtype="Int64"))

    return run


def image_statistics(files: DataFrame, reader: Callable[[bytes], np.ndarray | None] = decode) -> DataFrame:
    """path, folder, name, mean, kinds (distinct values), zeros (values, of all channels) of each file; nulls where it can't be read."""
    rows = files.select("path", "folder", "name", "content")
    return rows.mapInPandas(_statistics(reader), "path string, folder string, name string, mean double, kinds long, zeros long")


def kept_images(statistics: DataFrame) -> DataFrame:
    """Adds keep: images of valid brightness, variety and coverage; not those of folders with one file, or taken before or after. Masks and other files are kept."""
    image = F.rlike(F.lower("name"), F.lit(r"\.(jpg|jpeg|png|ppm|pgm|npy)$"))
    mask = F.contains("name", F.lit("cloud"))
    valid = F.coalesce(F.col("mean").between(DARK, BRIGHT) & (F.col("kinds") >= KINDS) & (F.col("zeros") <= ZEROS), F.lit(False))
    timed = F.contains("path", F.lit("before")) | F.contains("path", F.lit("after"))
    alone = statistics.groupBy("folder").agg(F.count("*").alias("_files")).filter("_files = 1").select("folder", F.lit(True).alias("_alone"))
    rows = statistics.join(alone, "folder", "left")
    return rows.withColumn("keep", ~F.coalesce("_alone", F.lit(False)) & (~image | mask | (valid & ~timed))).drop("_alone")


def download_choice(mean, tried: bool = False):
    """What to do with a download of a mean brightness: try again if dark (once), drop if bright, else keep."""
    again = F.lit("keep") if tried else F.lit("retry")
    return F.when(mean > 200, "drop").when(mean < 30, again).otherwise("keep")


def clear_sky(quality: Column) -> Column:
    """Whether bits 10 (clouds) and 11 (cirrus) of a quality value are both zero."""
    return (quality.bitwiseAND(F.lit(1 << 10)) == 0) & (quality.bitwiseAND(F.lit(1 << 11)) == 0)


def reflectance(value: Column, quality: Column) -> Column:
    """The value over 10,000 where the sky is clear, else null."""
    return F.when(clear_sky(quality), value / 10000)


def two_valued(value: Column) -> Column:
    """A mask pixel: 255 for anything but zero."""
    return F.when(value != 0, 255).otherwise(value)
