"""Image files: Spark's own image source decodes them in the JVM; turning, grey values, resizing and PNG files are numpy in Arrow batches.

A decoded image travels only from the scan to the worker that shrinks it; what
leaves a map is the small image. Nothing is shuffled.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Quarter turns of each orientation, and the orientation behind each EXIF number (mirrored ones first flip left and right).
TURNS = {"none": 0, "identity": 0, "ccw90": 1, "180": 2, "cw90": 3}
EXIF = {1: "none", 2: "mirror", 3: "180", 4: "mirror 180", 5: "mirror ccw90", 6: "cw90", 7: "mirror cw90", 8: "ccw90"}


def read_images(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(path, width_px, height_px, channels, data as rows of BGR, BGRA or grey bytes) of the image files below a path.

    A file that is no image is an error, or a row of nulls if not ``strict``. EXIF
    tags are not applied by the decoder; ``exif_transform`` reads them.
    """
    rows = spark.read.format("image").load(path).select("image.*")
    fine = F.col("height") > 0
    if strict:
        rows = rows.where(F.when(fine, True).otherwise(F.raise_error(F.concat(F.lit("not an image: "), F.coalesce("origin", F.lit("?")))).cast("boolean")))
    own = lambda c: F.when(fine, F.col(c))
    return rows.select(F.col("origin").alias("path"), own("width").alias("width_px"), own("height").alias("height_px"), own("nChannels").alias("channels"), own("data").alias("data"))


def _exif_number(content: bytes) -> int:
    """The orientation number in the EXIF block of a JPEG or PNG file; 1 where there is none."""
    at = content.find(b"Exif\0\0")
    tiff = content[at + 6 :] if at >= 0 else b""
    if not tiff and (at := content.find(b"eXIf")) >= 0:
        tiff = content[at + 4 :]
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    try:
        (start,) = struct.unpack_from(order + "I", tiff, 4)
        (n,) = struct.unpack_from(order + "H", tiff, start)
        for k in range(n):
            tag, _, _, value = struct.unpack_from(order + "HHIH", tiff, start + 2 + 12 * k)
            if tag == 0x0112:
                return value if value in EXIF else 1
    except (struct.error, TypeError):
        pass
    return 1


@F.pandas_udf(T.StringType())
def exif_transform(content: pd.Series) -> pd.Series:
    """The orientation that a file's EXIF block asks for ('none' without one). Give it the first 64 KB of the content; later blocks do not count."""
    return content.map(lambda c: EXIF[_exif_number(bytes(c))] if c is not None else "none")


def pixels(data: bytes, height: int, channels: int) -> np.ndarray:
    """(height, width, 3 or 1) in RGB order; an alpha channel is left out."""
    a = np.frombuffer(data, np.uint8).reshape(height, -1, channels)
    return a if channels == 1 else a[:, :, 2::-1]


def turned(image: np.ndarray, transform: str | None) -> np.ndarray:
    """The image as its transform says; an unknown name is an error, null is 'none'."""
    names = (transform or "none").split(" ")
    if names[0] == "mirror":
        image, names = image[:, ::-1], names[1:] or ["none"]
    if len(names) != 1 or names[0] not in TURNS:
        raise ValueError(f"unknown transform {transform}")
    return np.rot90(image, TURNS[names[0]])


def grey_values(image: np.ndarray) -> np.ndarray:
    """Luma of 8-bit colours in whole numbers, as ``functions.images.grey`` has it."""
    if image.shape[2] == 1:
        return image[:, :, 0]
    r, g, b = (image[:, :, k].astype(np.int64) for k in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16).astype(np.uint8)


def triangle(x: np.ndarray) -> np.ndarray:
    return np.clip(1.0 - np.abs(x), 0.0, None)


def lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3.0, np.sinc(x) * np.sinc(x / 3.0), 0.0)


def resized(image: np.ndarray, width: int, height: int, kernel: Callable[[np.ndarray], np.ndarray] = triangle) -> np.ndarray:
    """The image at another size: first rows, then columns, each rounded to 8 bits; the kernel widens when it shrinks."""

    def along(values: np.ndarray, n: int) -> np.ndarray:
        scale = values.shape[0] / n
        apart = (np.arange(values.shape[0]) + 0.5)[None] - ((np.arange(n) + 0.5) * scale)[:, None]
        weight = kernel(apart / max(scale, 1.0))
        mixed = np.tensordot(weight / weight.sum(1, keepdims=True), values, 1)
        return np.clip(np.floor(mixed + 0.5), 0, 255).astype(np.uint8)

    wide = along(image.swapaxes(0, 1), width).swapaxes(0, 1) if width != image.shape[1] else image
    return along(wide, height) if height != image.shape[0] else wide


def png(image: np.ndarray) -> bytes:
    """A PNG file of 8-bit grey (height, width) or colour (height, width, 3) values."""
    image = image[:, :, 0] if image.ndim == 3 and image.shape[2] == 1 else image

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    rows = b"".join(b"\0" + np.ascontiguousarray(r).tobytes() for r in image)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def _shrink(images: DataFrame, transform: Column, schema: str, work: Callable[[np.ndarray], tuple]) -> DataFrame:
    """(path, work's columns) for each image, turned first. Images of nulls give nulls. Spark bounds a batch at 64 MB (spark.sql.execution.arrow.maxBytesPerBatch)."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, data, height, channels, how in f.itertuples(index=False):
                rows.append((path, *(work(turned(pixels(data, int(height), int(channels)), how)) if data is not None else [None] * len(names))))
            yield pd.DataFrame(rows, columns=["path", *names])

    return images.select("path", "data", "height_px", "channels", transform.alias("how")).mapInPandas(run, f"path string, {schema}")


def motion_images(images: DataFrame, transform: Column, width: int = 160, height: int = 120) -> DataFrame:
    """(path, pixels array<double> row by row): turned, grey, resized bilinearly; what ``timeseries.strided_motion`` compares.

    transform: a column over ``read_images``, of 'none', 'ccw90', 'cw90', '180' or what ``exif_transform`` gives.
    """
    return _shrink(images, transform, "pixels array<double>", lambda a: (resized(grey_values(a), width, height).astype(float).ravel(),))


def thumbnails(images: DataFrame, transform: Column, width: int = 480) -> DataFrame:
    """(path, width_px, height_px, thumbnail): PNG files of the given width and the image's own shape, by a Lanczos kernel."""
    if width < 1:
        raise ValueError("width must be positive")

    def work(a: np.ndarray) -> tuple:
        small = resized(a, width, max(1, round(a.shape[0] * (width / a.shape[1]))), lanczos)
        return small.shape[1], small.shape[0], png(small)

    return _shrink(images, transform, "width_px int, height_px int, thumbnail binary", work)


def verify_images(records: DataFrame, files: DataFrame) -> DataFrame:
    """Records (path, image_sha256) whose file has that digest; a missing file or another digest is an error.

    files: ``sources.bind_sources`` of the folder, so only digests are joined and never images.
    """
    own = records.join(files.select("path", F.col("sha256").alias("_found")), "path", "left")
    bad = F.raise_error(F.concat(F.lit("an image is missing or has another digest than recorded: "), F.coalesce("path", F.lit("?")))).cast("boolean")
    return own.where(F.when(F.col("_found") == F.col("image_sha256"), True).otherwise(bad)).drop("_found")


def render_pages(documents: DataFrame, render: Callable[[bytes, float], Iterator[np.ndarray]], dpi: int) -> DataFrame:
    """(source_id, page_number from 1, image, image_sha256, width_px, height_px, render_dpi) from (source_id, content).

    render: the document's pages as arrays of 8-bit values at a scale of dpi / 72; there is no PDF library here.
    """
    if dpi < 72:
        raise ValueError("dpi must be 72 or more")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for source, content in zip(f["source_id"], f["content"], strict=True):
                for n, page in enumerate(render(bytes(content), dpi / 72.0), 1):
                    yield pd.DataFrame([(source, n, png(page), page.shape[1], page.shape[0])], columns=["source_id", "page_number", "image", "width_px", "height_px"])

    out = documents.select("source_id", "content").mapInPandas(run, "source_id string, page_number int, image binary, width_px int, height_px int")
    return out.withColumn("image_sha256", F.sha2("image", 256)).withColumn("render_dpi", F.lit(dpi))
