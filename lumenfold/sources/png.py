"""PNG images as arrays: grey, colour and their forms with alpha, 8 and 16 bits, without interlacing or palettes."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Fixed values of the format: the signature, and the samples of a pixel for each colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}
COLOUR_TYPE = {n: t for t, n in SAMPLES.items()}
MOST_PIXELS = 100_000_000  # of an image that is decoded


class BadImage(ValueError):
    """Not an image of a kind that is read here, or a damaged one."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(image: np.ndarray, level: int = 6) -> bytes:
    """A file of an array of rows x columns (x samples) of unsigned bytes or 16-bit numbers. Every row is stored as its
    difference to the one above."""
    image = image[:, :, None] if image.ndim == 2 else image
    height, width, samples = image.shape
    if image.dtype not in (np.uint8, np.uint16) or samples not in COLOUR_TYPE or 0 in (height, width):
        raise ValueError("an image has rows and columns of 1 to 4 unsigned samples of 8 or 16 bits")
    flat = np.ascontiguousarray(image, dtype=image.dtype.newbyteorder(">")).view(np.uint8).reshape(height, -1)
    rows = np.empty((height, flat.shape[1] + 1), np.uint8)
    rows[:, 0] = 2
    rows[0, 1:] = flat[0]
    rows[1:, 1:] = flat[1:] - flat[:-1]
    head = struct.pack(">IIBBBBB", width, height, 8 * image.dtype.itemsize, COLOUR_TYPE[samples], 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def decode(blob: bytes) -> np.ndarray:
    """Rows x columns x samples of a file."""
    if blob[:8] != SIGNATURE:
        raise BadImage("no signature")
    at, head, data = 8, None, []
    try:
        while True:
            size, kind = struct.unpack_from(">I4s", blob, at)
            body = blob[at + 8 : at + 8 + size]
            if len(body) != size or struct.unpack_from(">I", blob, at + 8 + size)[0] != zlib.crc32(kind + body):
                raise BadImage("damaged chunk")
            at += size + 12
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", body)
            elif kind == b"IDAT":
                data.append(body)
            elif kind == b"IEND":
                break
        width, height, depth, colour, _, _, interlaced = head
        if depth not in (8, 16) or colour not in SAMPLES or interlaced or not 0 < width * height <= MOST_PIXELS:
            raise BadImage("a kind of image that is not read")
        step = SAMPLES[colour] * depth // 8
        want = height * (width * step + 1)
        # No more than the header promises is unpacked.
        raw = zlib.decompressobj().decompress(b"".join(data), want)
    except (struct.error, zlib.error, TypeError) as e:
        raise BadImage(str(e)) from None
    if len(raw) != want:
        raise BadImage("too few rows")
    rows = np.frombuffer(raw, np.uint8).reshape(height, -1)
    out = _unfilter(rows[:, 0], rows[:, 1:].reshape(height, width, step))
    if depth == 16:
        return out.reshape(height, width, -1, 2).view(">u2").astype(np.uint16).reshape(height, width, -1)
    return out


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo each row's filter; bytes add up modulo 256."""
    out = np.empty_like(rows)
    above = np.zeros(rows.shape[1:], np.uint8)
    for y, (kind, row) in enumerate(zip(kinds.tolist(), rows)):
        if kind == 0:
            out[y] = row
        elif kind == 1:
            out[y] = np.cumsum(row, axis=0, dtype=np.uint8)
        elif kind == 2:
            out[y] = row + above
        elif kind in (3, 4):
            out[y] = (_average if kind == 3 else _paeth)(row.tolist(), above.tolist())
        else:
            raise BadImage("unknown filter")
        above = out[y]
    return out


def _average(row: list, above: list) -> list:
    left, out = [0] * len(row[0]), []
    for x, up in zip(row, above):
        left = [(v + (a + b) // 2) & 255 for v, a, b in zip(x, left, up)]
        out.append(left)
    return out


def _paeth(row: list, above: list) -> list:
    """Each byte adds to that of left, above and corner which is nearest to left + above - corner."""
    left, corner, out = [0] * len(row[0]), [0] * len(row[0]), []
    for x, up in zip(row, above):
        left = [(v + min((a, b, c), key=lambda p: abs(a + b - c - p))) & 255 for v, a, b, c in zip(x, left, up, corner)]  # noqa: B023
        corner = up
        out.append(left)
    return out


def nearest(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The image at another size, each pixel the source's at the scaled place, rounded down."""
    rows, columns = np.arange(height) * image.shape[0] // height, np.arange(width) * image.shape[1] // width
    return image[rows][:, columns]
