"""PNG media in binary columns: chunks, checksums, filters and cosine-transform hashes.

``pack`` stores any byte payload losslessly as an 8-bit greyscale PNG, 64
samples wide, each row with the best of the five filters; ``unpack`` reads a
PNG column back (checksum of every chunk, zlib stream, row filters undone with
numpy) and computes a 64-bit hash from the low frequencies of a two-dimensional
cosine transform.

Average and Paeth look at the left, upper and upper left sample at once, so
they are undone along diagonals: all samples of one diagonal, of many images
together, in one numpy step.

Defined results: a null payload is an empty one; a payload is padded with
zero bytes to a positive multiple of 64; bytes that are not a sound PNG give
a row with ``error`` set and null features; rows are handled one by one, and
only the id and payload columns are read, whatever the names of the others.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
MAGIC = b"\x89PNG\r\n\x1a\n"  # fixed value
#: Samples per pixel by colour type (fixed values).
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Which of the three (int16) lies nearest to left + up - corner, ties in this order."""
    by_left, by_up, by_corner = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
    return np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))


def filter_rows(pixels: np.ndarray) -> np.ndarray:
    """Rows with the filter byte that gives the smallest sum of absolute differences, of all five."""
    height, width = pixels.shape
    padded = np.zeros((height + 1, width + 1), dtype=np.int16)
    padded[1:, 1:] = pixels
    left, up, corner = padded[1:, :-1], padded[:-1, 1:], padded[:-1, :-1]
    guesses = (np.zeros_like(left), left, up, (left + up) >> 1, paeth(left, up, corner))
    choices = [(padded[1:, 1:] - g).astype(np.uint8) for g in guesses]
    costs = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in choices])
    best = costs.argmin(axis=0)
    out = np.empty((height, width + 1), dtype=np.uint8)
    out[:, 0] = best
    for k, x in enumerate(choices):
        rows = best == k
        out[rows, 1:] = x[rows]
    return out


def encode(pixels: np.ndarray, level: int = 2, chunk_bytes: int = 1 << 16) -> bytes:
    """A greyscale PNG of a (height, width) uint8 array."""
    height, width = pixels.shape
    data = zlib.compress(filter_rows(pixels).tobytes(), level)
    body = b"".join(chunk(b"IDAT", data[i : i + chunk_bytes]) for i in range(0, len(data), chunk_bytes))
    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + body + chunk(b"IEND", b"")


def unfilter(rows: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the row filters of one image."""
    return unfilter_all([rows], bpp)[0]


def unfilter_all(images: list[np.ndarray], bpp: int) -> list[np.ndarray]:
    """Undo the row filters of images of one width: (height, 1 + stride) arrays in, (height, stride) out."""
    heights = [len(x) for x in images]
    rows = np.concatenate(images)
    total, width = len(rows), (rows.shape[1] - 1) // bpp
    kinds = rows[:, 0]
    if total and int(kinds.max()) > 4:
        raise ValueError("unknown row filter")
    raw = rows[:, 1:].reshape(total, width, bpp).astype(np.int16)
    level = np.concatenate([np.arange(h) for h in heights]) if heights else np.zeros(0, np.int64)
    # sample x of row y is stored at (y + 1, x + 1); row 0 and column 0 are zeros
    out = np.zeros((total + 1, width + 1, bpp), dtype=np.int16)
    above = np.where(level > 0, np.arange(total), 0)
    order = np.argsort(level, kind="stable")
    steps = np.arange(width + (max(heights, default=0) or 1) - 1)
    first = np.searchsorted(level[order], steps - width + 1)
    last = np.searchsorted(level[order], steps, side="right")
    kind = kinds[:, None]
    for t, a, b in zip(steps.tolist(), first.tolist(), last.tolist(), strict=True):
        y = order[a:b]
        x, high, k = t - level[y], above[y], kind[y]
        left, up, corner = out[y + 1, x], out[high, x + 1], out[high, x]
        guess = np.where(k == 1, left, np.where(k == 2, up, np.where(k == 3, (left + up) >> 1, np.where(k == 4, paeth(left, up, corner), 0))))
        out[y + 1, x + 1] = (raw[y, x] + guess) & 255
    done = out[1:, 1:].astype(np.uint8).reshape(total, width * bpp)
    return np.split(done, np.cumsum(heights)[:-1]) if heights else []


def rows_of(data: bytes) -> tuple[np.ndarray, int]:
    """(rows with their filter bytes, bytes per sample) of an 8-bit PNG that isn't interlaced; ValueError if it is not sound."""
    if data[:8] != MAGIC:
        raise ValueError("no PNG signature")
    at, header, parts, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("a chunk is cut off")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body, crc = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(crc) < 4 or struct.unpack(">I", crc)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if header is None or not ended:
        raise ValueError("no header or no end")
    width, height, depth, colour, _, _, interlace = header
    if depth != 8 or colour not in CHANNELS or interlace:
        raise ValueError("only 8-bit samples without interlace are read")
    bpp = CHANNELS[colour]
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise ValueError(f"zlib: {e}") from None
    if len(raw) != height * (width * bpp + 1):
        raise ValueError("wrong number of samples")
    rows = np.frombuffer(raw, dtype=np.uint8).reshape(height, width * bpp + 1)
    if height and int(rows[:, 0].max()) > 4:
        raise ValueError("unknown row filter")
    return rows, bpp


def decode(data: bytes) -> np.ndarray:
    """(height, width, channels) samples of a PNG; ValueError if it is not sound."""
    rows, bpp = rows_of(data)
    return unfilter(rows, bpp).reshape(len(rows), -1, bpp)


def decode_all(media: list[bytes], most: int = 4 << 20) -> list[np.ndarray | str]:
    """The samples of each image, or what is wrong with it; images of one shape are undone together, ``most`` bytes at a time."""
    out: list = [None] * len(media)
    open_: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}

    def close(shape: tuple[int, int]) -> None:
        some = open_.pop(shape)
        for (i, rows), got in zip(some, unfilter_all([r for _, r in some], shape[1]), strict=True):
            out[i] = got.reshape(len(rows), -1, shape[1])

    for i, data in enumerate(media):
        try:
            rows, bpp = rows_of(data)
        except ValueError as e:
            out[i] = str(e)
            continue
        shape = rows.shape[1], bpp
        open_.setdefault(shape, []).append((i, rows))
        if sum(r.size for _, r in open_[shape]) > most:
            close(shape)
    for shape in list(open_):
        close(shape)
    return out


def cosine_matrix(n: int, keep: int) -> np.ndarray:
    k, x = np.arange(keep)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n))


_ROWS = cosine_matrix(32, 8)


def shrink(grey: np.ndarray, size: int = 32) -> np.ndarray:
    """Area means on a size x size grid; samples are repeated where there are fewer."""

    def means(x: np.ndarray) -> np.ndarray:
        n = x.shape[0]
        if n < size:
            return x[np.arange(size) * n // size]
        cuts = np.arange(size) * n // size
        return np.add.reduceat(x, cuts, axis=0) / np.diff(np.append(cuts, n)).reshape(-1, *[1] * (x.ndim - 1))

    return means(means(grey.astype(np.float64)).T).T


def cosine_hash(pixels: np.ndarray) -> int:
    """64 bits: which of the 8 x 8 lowest frequencies lie above their median (the constant term is left out of it)."""
    grey = pixels.mean(axis=2) if pixels.ndim == 3 and pixels.shape[2] > 1 else pixels.reshape(pixels.shape[:2])
    low = np.round((_ROWS @ shrink(grey) @ _ROWS.T).ravel(), 6)
    return int(np.packbits(low > np.median(low[1:])).view(">u8")[0])


PACKED = "id {kind}, n_bytes bigint, media binary"
FEATURES = "id {kind}, n_bytes bigint, width bigint, height bigint, payload binary, media_bytes bigint, media_sha256 string, feature string, error string"


def pack(df: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(id, n_bytes, media): each payload stored as a PNG in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _pieces(batch):
                sizes, media = [], []
                for x in some.column(1):
                    raw = x.as_py() or b""
                    padded = np.zeros(max(1, -(-len(raw) // WIDTH)) * WIDTH, dtype=np.uint8)
                    padded[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
                    sizes.append(len(raw))
                    media.append(encode(padded.reshape(-1, WIDTH)))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(payload_col).cast("binary")).mapInArrow(run, PACKED.format(kind=kind))


def _pieces(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def unpack(df: DataFrame, with_payload: bool = True) -> DataFrame:
    """Read (id, n_bytes, media) back: samples, digests of the stored form and the cosine hash.

    ``with_payload=False`` gives the payload's digests in place of its bytes:
    ``payload_bytes, payload_sha256, tail_crc32``.
    """
    kind = df.schema["id"].dataType.simpleString()
    schema = FEATURES.format(kind=kind)
    if not with_payload:
        schema = schema.replace("payload binary", "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint")
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _pieces(batch):
                out: dict[str, list] = {n: [] for n in names[2:]}
                media = [x.as_py() or b"" for x in some.column(2)]
                for data, got in zip(media, decode_all(media), strict=True):
                    pixels, payload, feature, error = None, None, None, got
                    if not isinstance(got, str):
                        pixels, payload, feature, error = got, got.tobytes(), f"{cosine_hash(got):016x}", None
                    row = {"width": pixels.shape[1] if pixels is not None else None, "height": pixels.shape[0] if pixels is not None else None}
                    row |= {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": feature, "error": error}
                    if with_payload:
                        row["payload"] = payload
                    elif payload is None:
                        row |= {"payload_bytes": None, "payload_sha256": None, "tail_crc32": None}
                    else:
                        row |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-WIDTH:])}
                    for n in names[2:]:
                        out[n].append(row[n])
                types = [pa.binary() if n == "payload" else pa.string() if n in ("media_sha256", "payload_sha256", "feature", "error") else pa.int64() for n in names[2:]]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *(pa.array(out[n], t) for n, t in zip(names[2:], types, strict=True))], names)

    return df.mapInArrow(run, schema)
