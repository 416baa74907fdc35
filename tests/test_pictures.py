"""Image files: the codec on its own, the frame source and its pushed filters, keyframes, depth."""

import json
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold import api
from lumenfold.sources import captures, files, pictures, png


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.integers(1, 20), st.integers(1, 4), st.booleans(), st.integers(0, 2**32 - 1))
def test_round_trip(height, width, samples, wide, seed):
    kind = np.uint16 if wide else np.uint8
    image = np.random.default_rng(seed).integers(0, np.iinfo(kind).max, (height, width, samples), endpoint=True).astype(kind)
    back = png.decode(png.encode(image))
    assert back.dtype == kind and (back == image).all()


def filtered(image, kinds):
    """A file whose rows use the given filters, by their definitions for one byte at a time."""
    height, width, step = image.shape
    raw = bytearray()
    for y in range(height):
        raw.append(kinds[y])
        for x in range(width):
            for s in range(step):
                a = int(image[y, x - 1, s]) if x else 0
                b = int(image[y - 1, x, s]) if y else 0
                c = int(image[y - 1, x - 1, s]) if x and y else 0
                p = a + b - c
                near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
                raw.append((int(image[y, x, s]) - [0, a, b, (a + b) // 2, near][kinds[y]]) % 256)
    head = struct.pack(">IIBBBBB", width, height, 8, png.COLOUR_TYPE[step], 0, 0, 0)
    body = zlib.compress(bytes(raw))
    parts = [png._chunk(b"IHDR", head), png._chunk(b"tEXt", b"note\0x"), png._chunk(b"IDAT", body[:7]), png._chunk(b"IDAT", body[7:]), png._chunk(b"IEND", b"")]
    return png.SIGNATURE + b"".join(parts)


@pytest.mark.parametrize("step", [1, 2, 3, 4])
def test_every_filter(step):
    image = np.random.default_rng(step).integers(0, 256, (10, 7, step)).astype(np.uint8)
    assert (png.decode(filtered(image, [0, 1, 2, 3, 4, 4, 3, 2, 1, 0])) == image).all()
    assert (png.decode(filtered(image, [4] * 10)) == image).all()


def test_damaged_and_foreign_files():
    good = png.encode(np.zeros((4, 4), np.uint8))
    flipped = bytearray(good)
    flipped[-20] ^= 1
    for blob in (b"", b"no image", good[:-14], bytes(flipped), good[:20], png.SIGNATURE):
        with pytest.raises(png.BadImage):
            png.decode(blob)
    with pytest.raises(ValueError):
        png.encode(np.zeros((4, 4)))
    big = png.SIGNATURE + png._chunk(b"IHDR", struct.pack(">IIBBBBB", 10**6, 10**6, 8, 0, 0, 0, 0)) + png._chunk(b"IEND", b"")
    with pytest.raises(png.BadImage):
        png.decode(big)


def test_nearest():
    image = np.arange(12).reshape(3, 4)
    assert png.nearest(image, 6, 2).tolist() == [[0, 2], [0, 2], [4, 6], [4, 6], [8, 10], [8, 10]]
    assert (png.nearest(image, 3, 4) == image).all()


def frames_of(spark, clips, count, channels=3):
    rng = np.random.default_rng(0)
    rows = [(v, i, rng.integers(0, 256, (5, 6, channels)).astype(np.uint8).tobytes(), 5, 6, channels) for v in clips for i in range(count)]
    return spark.createDataFrame(rows, pictures.FRAMES), {(r[0], r[1]): r[2] for r in rows}


@pytest.mark.parametrize("channels", [1, 3])
def test_filters_reach_the_list_of_files(spark, tmp_path, channels):
    from pyspark.sql import functions as F

    frames, want = frames_of(spark, (2, 10), 12, channels)
    at = f"file://{tmp_path}/seq"
    files.write_many(pictures.encode_frames(frames, F.format_string("clip%d/frame_%05d.png", "video", "frame_idx")), at)
    (tmp_path / "seq" / "clip2" / "notes.txt").write_text("x")
    got = pictures.frame_files(spark, at)
    assert {(r.video, r.frame_idx): bytes(r.pixels) for r in got.collect()} == want
    assert {r.frame_idx for r in pictures.frame_files(spark, at, 5).collect()} == {0, 5, 10}
    # A damaged file is only met by reads that ask for it.
    (tmp_path / "seq" / "clip2" / "frame_00007.png").write_bytes(b"damaged")
    for condition in ("frame_idx < 7", "frame_idx in (1, 4, 11)", "video = 10 and frame_idx >= 3", "frame_idx > 7 and frame_idx <= 9"):
        df = got.where(condition)
        assert {(r.video, r.frame_idx) for r in df.collect()} == {(r.video, r.frame_idx) for r in frames.where(condition).collect()}
    with pytest.raises(Exception, match="no signature"):
        got.where("frame_idx = 7").collect()
    # A filter that is not pushed is left to Spark.
    assert got.where("frame_idx < 3 and frame_idx % 2 = 1").count() == 2


def test_ingest_of_a_folder_writes_its_keyframes(spark, tmp_path):
    from pyspark.sql import functions as F

    from lumenfold.operators.frames import IngestConfig

    clip = captures.synthetic_clip(spark)
    files.write_many(pictures.encode_frames(clip, F.format_string("frame_%04d.png", "frame_idx")), f"{tmp_path}/clip")
    cfg = IngestConfig(target_frames=6, sample_stride=2, proc_width=48, thumb_width=32)
    out = api.run_ingest(spark, f"{tmp_path}/clip", f"{tmp_path}/r", cfg)
    table = api.run_ingest(spark, clip, f"{tmp_path}/t", cfg)
    assert {k: out[k] for k in ("analysed_frames", "selected_frames", "median_sharpness")} == {k: table[k] for k in ("analysed_frames", "selected_frames", "median_sharpness")}
    rep = [f for f in json.loads((tmp_path / "r" / "frame_report.json").read_text())["frames"] if f["selected"]]
    pixels = {r.frame_idx: np.frombuffer(r.pixels, np.uint8).reshape(36, 64, 1) for r in clip.collect()}
    assert [f["path"] for f in rep] == [f"frame_{k:04d}.png" for k in range(len(rep))]
    for f in rep:
        assert (png.decode((tmp_path / "r" / "images" / f["path"]).read_bytes()) == pixels[f["index"]]).all()
        assert png.decode((tmp_path / "r" / "images" / f["thumb"]).read_bytes()).shape == (18, 32, 1)


def test_depth(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(0, [0.0, 1.2344, 70.0, None, float("nan"), float("inf")], 3), (1, [0.5] * 4, 2)]
    df = spark.createDataFrame(rows, "id long, depth array<double>, width int")
    files.write_many(pictures.depth_documents(df, F.format_string("d%d.png", "id")), str(tmp_path))
    (tmp_path / "bad.png").write_bytes(b"x")
    (tmp_path / "grey.png").write_bytes(png.encode(np.zeros((2, 2), np.uint8)))
    got = {r.path.rsplit("/", 1)[1]: (r.height, r.width, r.depth) for r in pictures.depth_files(spark, str(tmp_path)).collect()}
    assert got == {"d0.png": (2, 3, [0.0, 1.234, 65.535, 0.0, 0.0, 0.0]), "d1.png": (2, 2, [0.5] * 4)}
    small = {r.path.rsplit("/", 1)[1]: r.depth for r in pictures.depth_files(spark, str(tmp_path), 1, 2).collect()}
    assert small == {"d0.png": [0.0, 1.234], "d1.png": [0.5, 0.5]}
