"""Image files: decoding, turning, resizing, digests."""

import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode import sources as Q
from tracelode.sources import images as P


def picture(height=9, width=12, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3), dtype=np.uint8)


def test_png_round_trip(spark, tmp_path):
    a = picture()
    (tmp_path / "colour.png").write_bytes(P.png(a))
    (tmp_path / "grey.png").write_bytes(P.png(a[:, :, 0]))
    got = {r.path.rsplit("/", 1)[1]: r for r in P.read_images(spark, f"file://{tmp_path}").collect()}
    assert (P.pixels(bytes(got["colour.png"].data), 9, 3) == a).all()
    assert (P.pixels(bytes(got["grey.png"].data), 9, 1)[:, :, 0] == a[:, :, 0]).all()
    assert (got["grey.png"].width_px, got["grey.png"].height_px) == (12, 9)


def test_not_an_image(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(b"no image")
    row = P.read_images(spark, f"file://{tmp_path}", strict=False).first()
    assert row.width_px is None and row.data is None
    assert P.motion_images(P.read_images(spark, f"file://{tmp_path}", strict=False), F.lit("none")).first().pixels is None
    with pytest.raises(Exception, match="not an image"):
        P.read_images(spark, f"file://{tmp_path}").collect()


def slow_resize(values, n):
    """One axis of a list of numbers by a triangle kernel, in plain loops."""
    scale = len(values) / n
    out = []
    for k in range(n):
        centre = (k + 0.5) * scale
        w = [max(0.0, 1 - abs(i + 0.5 - centre) / max(scale, 1.0)) for i in range(len(values))]
        out.append(int(np.floor(sum(x * y for x, y in zip(w, values, strict=True)) / sum(w) + 0.5)))
    return out


def test_resize():
    a = P.grey_values(picture())
    for width, height in ((5, 4), (12, 9), (30, 20)):
        rows = [slow_resize([int(x) for x in r], width) if width != 12 else [int(x) for x in r] for r in a]
        cols = [slow_resize(list(c), height) if height != 9 else list(c) for c in zip(*rows, strict=True)]
        apart = np.abs(P.resized(a, width, height).astype(int) - np.array(cols).T)
        assert apart.max() <= 1 and (apart > 0).mean() < 0.1  # sums in another order differ where a value ends in a half
    flat = np.full((7, 11, 3), 200, np.uint8)
    assert (P.resized(flat, 4, 3, P.lanczos) == 200).all()


def test_motion_images_and_thumbnails(spark, tmp_path):
    a = picture(6, 8)
    (tmp_path / "f.png").write_bytes(P.png(a))
    images = P.read_images(spark, f"file://{tmp_path}")
    got = P.motion_images(images, F.lit("ccw90"), 6, 8).first()
    assert got.pixels == P.grey_values(np.rot90(a)).astype(float).ravel().tolist()
    thumb = P.thumbnails(images, F.lit("none"), 4).first()
    assert (thumb.width_px, thumb.height_px) == (4, 3)
    (tmp_path / "small").mkdir()
    (tmp_path / "small" / "t.png").write_bytes(bytes(thumb.thumbnail))
    back = P.read_images(spark, f"file://{tmp_path}/small").first()
    assert (P.pixels(bytes(back.data), 3, 3) == P.resized(a, 4, 3, P.lanczos)).all()
    with pytest.raises(Exception, match="unknown transform"):
        P.motion_images(images, F.lit("upside")).collect()


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif(spark, order):
    tiff = (b"II" if order == "<" else b"MM") + struct.pack(order + "HIH", 42, 8, 1) + struct.pack(order + "HHIHH", 0x0112, 3, 1, 6, 0)
    files = [(b"\xff\xd8\xff\xe1\0\0Exif\0\0" + tiff,), (b"\x89PNG....eXIf" + tiff,), (b"no tag",), (b"Exif\0\0II",), (None,)]
    got = spark.createDataFrame(files, "c binary").select(P.exif_transform("c").alias("t")).collect()
    assert [r.t for r in got] == ["cw90", "cw90", "none", "none", "none"]
    a = picture(2, 3)
    assert (P.turned(a, "mirror ccw90") == a.transpose(1, 0, 2)).all()
    assert (P.turned(a, "mirror 180") == a[::-1]).all()


def test_verify_images(spark, tmp_path):
    (tmp_path / "f.png").write_bytes(P.png(picture()))
    files = Q.bind_sources(spark, f"file://{tmp_path}")
    path, digest = files.first().path, hashlib.sha256((tmp_path / "f.png").read_bytes()).hexdigest()
    records = lambda *rows: spark.createDataFrame(rows, "path string, image_sha256 string")
    assert P.verify_images(records((path, digest)), files).count() == 1
    for row in ((path, "0"), ("file:/missing.png", digest)):
        with pytest.raises(Exception, match="another digest"):
            P.verify_images(records(row), files).collect()


def test_render_pages(spark):
    render = lambda content, scale: [np.full((int(4 * scale), 3), c, np.uint8) for c in content]
    docs = spark.createDataFrame([("s", b"\x01\x02"), ("t", b"")], "source_id string, content binary")
    got = P.render_pages(docs, render, 144).collect()
    assert [(r.source_id, r.page_number, r.width_px, r.height_px, r.render_dpi) for r in got] == [("s", 1, 3, 8, 144), ("s", 2, 3, 8, 144)]
    assert got[0].image_sha256 == hashlib.sha256(bytes(got[0].image)).hexdigest()
    with pytest.raises(ValueError, match="dpi"):
        P.render_pages(docs, render, 71)
