"""Media columns: Netpbm and BMP images to NPY tiles with difference hashes.

An image's bytes are decoded to a numpy array, stored losslessly as NPY tiles, read back, area-resized by an
integral image, and described by a difference hash. Texts take the same way as 24 samples wide grey maps.

Defined results: a null text is empty; an empty text is one padded tile; equal texts give equal values; a null or
broken image gives a null array (``decode_image`` raises ValueError for it). Memory is a small multiple of one image.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 24  #: samples on a tile's side; a tile holds 576 bytes
PAD = 255

STORED = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)

_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([0-9]+)(?=[\s#]|$)")
_COMMENT = re.compile(rb"#[^\n\r]*")


def _number(digits: bytes) -> int:
    """A number of an image's head or samples; ValueError beyond 31 bits, however many digits it has."""
    digits = digits.lstrip(b"0") or b"0"
    if not digits.isdigit() or len(digits) > 10 or int(digits) >= 1 << 31:
        raise ValueError("number out of range")
    return int(digits)


def _plain_samples(kind: bytes, body: bytes, count: int) -> np.ndarray:
    """The first count samples in digits; P1's need no white space between them."""
    body = _COMMENT.sub(b"", body)
    values = body.split()
    if kind == b"P1":
        joined = np.frombuffer(b"".join(values), np.uint8)[:count]
        if (joined >> 1 != ord("0") >> 1).any():
            raise ValueError("netpbm bit that is neither 0 nor 1")
        return joined & 1
    return np.array([_number(v) for v in values[:count]], np.int64)


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, need = data[:2], 2, 2 if data[:2] in (b"P1", b"P4") else 3
    head = []
    for _ in range(need):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("netpbm header ends early or holds no number")
        head.append(_number(m[1]))
        at = m.end()
    width, height = head[:2]
    most = head[2] if need == 3 else 1
    if width <= 0 or height <= 0 or not 0 < most < 65536:
        raise ValueError("netpbm header out of range")
    planes = 3 if kind in (b"P3", b"P6") else 1
    count = width * height * planes
    if kind in (b"P1", b"P2", b"P3"):
        if count > len(data):
            raise ValueError("netpbm data ends early")
        samples = _plain_samples(kind, data[at:], count)
    else:
        if not data[at : at + 1].isspace():
            raise ValueError("no white space after the netpbm header")
        at += 1
        row = (width + 7) // 8
        wanted = row * height if kind == b"P4" else count * (1 if most < 256 else 2)
        if wanted > len(data) - at:
            raise ValueError("netpbm data ends early")
        if kind == b"P4":
            bits = np.unpackbits(np.frombuffer(data, np.uint8, wanted, at).reshape(height, row), axis=1)
            samples = bits[:, :width].reshape(-1)
        else:
            samples = np.frombuffer(data, np.uint8 if most < 256 else ">u2", count, at)
    if len(samples) != count:
        raise ValueError("netpbm data ends early")
    if samples.max() > most:
        raise ValueError("netpbm sample above the largest value")
    if need == 2:
        samples = (1 - samples) * 255  # 1 is black
    elif most != 255:
        samples = (samples.astype(np.int64) * 255 + most // 2) // most
    return samples.astype(np.uint8).reshape((height, width, 3) if planes == 3 else (height, width))


def _bmp(data: bytes) -> np.ndarray:
    word = lambda at, size=4, signed=False: int.from_bytes(data[at : at + size], "little", signed=signed)
    if len(data) < 54:
        raise ValueError("bmp header ends early")
    offset, header, width, height = word(10), word(14), word(18, signed=True), word(22, signed=True)
    depth, packed = word(28, 2), word(30)
    if header < 40 or width <= 0 or height == 0 or (depth, packed) not in ((8, 0), (24, 0), (32, 0), (32, 3)):
        raise ValueError("bmp of an unknown kind")
    row = (width * depth // 8 + 3) // 4 * 4
    if row * abs(height) > len(data) - offset:
        raise ValueError("bmp data ends early")
    rows = np.frombuffer(data, np.uint8, row * abs(height), offset).reshape(abs(height), row)
    rows = rows[::-1] if height > 0 else rows
    if depth == 8:
        colours = word(46) or 256
        if colours > 256 or 14 + header + 4 * colours > len(data) or rows[:, :width].max() >= colours:
            raise ValueError("bmp colour out of range")
        table = np.frombuffer(data, np.uint8, 4 * colours, 14 + header).reshape(-1, 4)
        return table[rows[:, :width]][:, :, 2::-1].copy()
    planes = [2, 1, 0]  # blue comes first
    if packed == 3:
        masks = [word(54 + 4 * i) for i in range(3)]
        if len(data) < 66 or any(m not in (0xFF, 0xFF00, 0xFF0000, 0xFF000000) for m in masks) or len(set(masks)) < 3:
            raise ValueError("bmp masks that aren't whole bytes")
        planes = [(m.bit_length() - 1) // 8 for m in masks]
    return rows[:, : width * depth // 8].reshape(abs(height), width, depth // 8)[:, :, planes].copy()


def decode_image(data: bytes) -> np.ndarray:
    """P1 to P6 or BMP (8, 24 or 32 bits, not compressed) to uint8 samples: height x width, or x 3 for colours.

    ValueError for anything else: numbers out of range, samples above the largest value, data that end early.
    """
    try:
        if re.match(rb"P[1-6][\s#]", data):
            return _netpbm(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (IndexError, TypeError, OverflowError) as e:
        raise ValueError(f"broken image: {e}") from e
    raise ValueError("neither Netpbm nor BMP")


def encode_pgm(samples: np.ndarray) -> bytes:
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def area_resize(image: np.ndarray, height: int, width: int, rows_at_once: int = 4096) -> np.ndarray:
    """Mean of each target cell's area, fractions of pixels included, from the integral image.

    Only the integral's rows at cell borders are held; the rest passes by in blocks of rows.
    """
    h, w = image.shape
    ys, xs = np.arange(height + 1) * h / height, np.arange(width + 1) * w / width
    y0, x0 = np.minimum(ys.astype(np.int64), h - 1), np.minimum(xs.astype(np.int64), w - 1)
    need = np.unique(np.concatenate([y0, y0 + 1]))
    kept = np.zeros((len(need), w + 1), np.int64)
    carry = np.zeros(w, np.int64)
    for at in range(0, h, rows_at_once):
        block = image[at : at + rows_at_once]
        sums = np.cumsum(block, axis=0, dtype=np.int64) + carry
        inside = (need > at) & (need <= at + len(block))
        kept[inside, 1:] = np.cumsum(sums[need[inside] - at - 1], axis=1)
        carry = sums[-1]
    rows = {int(y): kept[i] for i, y in enumerate(need)}
    top = np.stack([rows[int(y)] for y in y0])
    low = np.stack([rows[int(y)] for y in y0 + 1])
    lines = top + (low - top) * (ys - y0)[:, None]
    grid = lines[:, x0] + (lines[:, x0 + 1] - lines[:, x0]) * (xs - x0)
    return np.diff(np.diff(grid, axis=0), axis=1) / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, row by row: 1 where a cell of 8 x 9 is darker than its right neighbour."""
    grey = image if image.ndim == 2 else image.astype(np.uint32).sum(axis=2) // 3
    cells = area_resize(grey, 8, 9)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def tiles_of(image: np.ndarray, tile: int = TILE, pad: int = PAD) -> np.ndarray:
    """Square tiles in row order, padded at the right and below: n x tile x tile (x 3)."""
    h, w = image.shape[:2]
    grow = [(0, -h % tile), (0, -w % tile)] + [(0, 0)] * (image.ndim - 2)
    full = np.pad(image, grow, constant_values=pad)
    cut = full.reshape(full.shape[0] // tile, tile, full.shape[1] // tile, tile, *full.shape[2:])
    return cut.swapaxes(1, 2).reshape(-1, tile, tile, *full.shape[2:])


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array), allow_pickle=False)
    return out.getvalue()


def image_to_npy(data: bytes | None) -> tuple[bytes, str] | None:
    """The stored form (NPY tiles) and difference hash of one image; None for null or broken data."""
    if data is None:
        return None
    try:
        image = decode_image(data)
    except ValueError:
        return None
    return npy_bytes(tiles_of(image)), difference_hash(image)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """A text's number of bytes, and its bytes with 255 up to a positive multiple of 576."""
    raw = (text or "").encode("utf-8")
    unit = TILE * TILE
    return len(raw), raw + bytes([PAD]) * (-len(raw) % unit if raw else unit)


def store_text(text: str | None) -> tuple[int, bytes]:
    """A text as a grey map of 24 samples a row, decoded and stored as NPY tiles."""
    n, payload = payload_of(text)
    pgm = encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, TILE))
    return n, npy_bytes(tiles_of(decode_image(pgm)))


def _described(text: str | None) -> tuple:
    n, media = store_text(text)
    back = np.load(io.BytesIO(media), allow_pickle=False)
    payload = back.tobytes()
    return (
        n,
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-32:]),
        len(media),
        hashlib.sha256(media).hexdigest(),
        difference_hash(back.reshape(-1, TILE)),
    )


def _describe(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in STORED.split(", ")]
    for batch in texts:
        yield pd.DataFrame([_described(t) for t in batch], columns=names)


def _images(data: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in data:
        yield pd.DataFrame([image_to_npy(x) or (None, None) for x in batch], columns=["media", "feature"])


def _texts(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([store_text(t)[1] for t in batch], dtype=object)


def store_images(df: DataFrame, image: str = "image", media: str = "media", feature: str = "feature") -> DataFrame:
    """Add each image's NPY tiles and difference hash; columns of those names are replaced."""
    named = df.withColumn("_sw_image", F.pandas_udf(_images, "media binary, feature string").asNondeterministic()(F.col(image)))
    named = named.withColumns({media: F.col("_sw_image.media"), feature: F.col("_sw_image.feature")})
    return named.drop("_sw_image")


def store_texts(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Add each text's stored form, NPY tiles of its padded bytes."""
    return df.withColumn(media, F.pandas_udf(_texts, "binary")(F.col(text).cast("string")))


def describe_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each whole text, read it back, and return sizes, digests and the difference hash, a row a document."""
    rows = df.select(F.col(doc_id), F.col(text).cast("string").alias("_sw_text"))
    told = rows.withColumn("_sw_told", F.pandas_udf(_describe, STORED).asNondeterministic()(F.col("_sw_text")))
    return told.select(doc_id, "_sw_told.*")
