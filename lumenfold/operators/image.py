"""Frame images as binary columns ``pixels`` (row-major bytes) with ``height, width, channels``: grey
resizing, sharpness, motion and structural similarity in NumPy over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Luma weights of red, green and blue.
LUMA = (0.299, 0.587, 0.114)


def area_resize(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """Mean of the source area under each target pixel, edges weighted by coverage."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        lo, hi = np.arange(n)[None, :], np.arange(1, n + 1)[None, :]
        cover = np.minimum(edges[1:, None], hi) - np.maximum(edges[:-1, None], lo)
        w = np.maximum(cover, 0)
        return w / w.sum(axis=1, keepdims=True)

    return weights(img.shape[0], height) @ img @ weights(img.shape[1], width).T


def grey(pixels: bytes, height: int, width: int, channels: int, order: str = "bgr", proc_width: int | None = 320) -> np.ndarray:
    a = np.frombuffer(pixels, dtype=np.uint8).reshape(height, width, channels).astype(np.float64)
    if channels >= 3:
        rgb = a[:, :, [2, 1, 0]] if order == "bgr" else a[:, :, :3]
        a = rgb @ np.array(LUMA)
    else:
        a = a[:, :, 0]
    if proc_width and width != proc_width:
        a = area_resize(a, proc_width, max(1, int(height * (proc_width / width))))
    return a


def sharpness(g: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian, borders mirrored without repeating the edge."""
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    return float(lap.var())


def ssim(a: np.ndarray, b: np.ndarray, size: int = 11, sigma: float = 1.5) -> float:
    """Mean structural similarity of images in 0 to 1 with a Gaussian window, zero outside the image."""
    x = np.arange(size) - size // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    k /= k.sum()

    def blur(m: np.ndarray) -> np.ndarray:
        pad = size // 2
        m = np.pad(m, pad)
        m = sum(k[i] * m[i : m.shape[0] - size + 1 + i, :] for i in range(size))
        return sum(k[i] * m[:, i : m.shape[1] - size + 1 + i] for i in range(size))

    ma, mb = blur(a), blur(b)
    va, vb, cov = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
    c1, c2 = 0.01**2, 0.03**2
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def photometric_loss(a: np.ndarray, b: np.ndarray, share: float = 0.2) -> float:
    return float((1 - share) * np.abs(a - b).mean() + share * (1 - ssim(a, b)))


def score_frames(frames: DataFrame, order: str = "bgr", proc_width: int = 320) -> DataFrame:
    """``video, frame_idx, sharpness, grey`` (processed bytes as doubles are not kept: ``grey`` is the reduced
    image, one byte a pixel), ready for the pairwise motion."""
    import pyarrow as pa

    def run(batches) -> Iterator:
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            sharp, small = [], []
            for px, h, w, c in zip(cols["pixels"].to_pylist(), *(cols[n].to_pylist() for n in ("height", "width", "channels"))):
                g = grey(px, h, w, c, order, proc_width)
                sharp.append(sharpness(g))
                small.append(np.clip(np.rint(g), 0, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([cols["video"], cols["frame_idx"], pa.array(sharp), pa.array(small, pa.binary())], ["video", "frame_idx", "sharpness", "grey"])

    src = frames.select(F.col("video").cast("long").alias("video"), F.col("frame_idx").cast("long").alias("frame_idx"), "pixels", "height", "width", "channels")
    return src.mapInArrow(run, "video long, frame_idx long, sharpness double, grey binary")


def with_motion(scored: DataFrame) -> DataFrame:
    """Add ``motion``: the mean absolute difference to the previous frame's grey bytes, 0 at first."""
    from pyspark.sql import Window as W

    @F.pandas_udf("double")
    def difference(a, b):
        import pandas as pd

        out = []
        for x, y in zip(a, b):
            if y is None or len(x) != len(y):
                out.append(0.0)
            else:
                out.append(float(np.abs(np.frombuffer(x, np.uint8).astype(np.int16) - np.frombuffer(y, np.uint8)).mean()))
        return pd.Series(out)

    prev = F.lag("grey").over(W.partitionBy("video").orderBy("frame_idx"))
    return scored.withColumn("__prev", prev).withColumn("motion", difference("grey", "__prev")).drop("__prev", "grey")


def with_similarity(pairs: DataFrame, width: int, a: str = "a", b: str = "b") -> DataFrame:
    """Add ``ssim`` and ``loss`` of two images, arrays of rows of ``width`` values in 0 to 1."""

    @F.pandas_udf("struct<ssim:double,loss:double>")
    def both(x, y):
        import pandas as pd

        images = [(np.asarray(p, float).reshape(-1, width), np.asarray(q, float).reshape(-1, width)) for p, q in zip(x, y)]
        return pd.DataFrame({"ssim": [ssim(p, q) for p, q in images], "loss": [photometric_loss(p, q) for p, q in images]})

    return pairs.withColumn("__s", both(a, b)).select(*pairs.columns, "__s.ssim", "__s.loss")
