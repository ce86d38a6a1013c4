from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest

from sievework.llm import media
from tests.llm.helpers import awkward, documents


def paeth_filter(rows, bpp, kinds):
    """Filter rows the plain way, all five kinds."""
    out, h, w = [], *rows.shape
    for y in range(h):
        line = []
        for x in range(w):
            a = int(rows[y, x - bpp]) if x >= bpp else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - bpp]) if y and x >= bpp else 0
            p = a + b - c
            pick = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((int(rows[y, x]) - [0, a, b, (a + b) // 2, pick][kinds[y]]) % 256)
        out.append(bytes([kinds[y], *line]))
    return b"".join(out)


@pytest.mark.parametrize("colour,bpp", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_all_filters_and_channels(colour, bpp):
    rng = np.random.default_rng(colour)
    rows = rng.integers(0, 256, (40, 7 * bpp), dtype=np.uint8)
    kinds = [int(k) for k in rng.integers(0, 5, 40)]
    raw = zlib.compress(paeth_filter(rows, bpp, kinds))
    png = media.MAGIC + media.chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 40, 8, colour, 0, 0, 0)) + media.chunk(b"tEXt", b"x") + media.chunk(b"IDAT", raw[:9]) + media.chunk(b"IDAT", raw[9:]) + media.chunk(b"IEND", b"")
    assert (media.decode(png).reshape(40, -1) == rows).all()


def test_round_trip_and_damage():
    rng = np.random.default_rng(1)
    for h in (1, 2, 33, 200):
        x = rng.integers(0, 256, (h, 64), dtype=np.uint8)
        x[h // 2 :] = np.arange(64)
        png = media.encode(x, chunk_bytes=100)
        assert (media.decode(png)[:, :, 0] == x).all()
        for at in (3, 20, 45, len(png) - 3):
            bad = bytearray(png)
            bad[at] ^= 1
            with pytest.raises(ValueError):
                media.decode(bytes(bad))
        with pytest.raises(ValueError):
            media.decode(png[:-12])


def test_hash_is_the_cosine_transform_and_tolerates_noise():
    image = np.kron(np.random.default_rng(3).integers(20, 230, (12, 8)), np.ones((8, 8))).astype(np.uint8)
    n = np.arange(32)
    plain = np.array([[(media.shrink(image) * np.cos(np.pi * (2 * n[:, None] + 1) * u / 64) * np.cos(np.pi * (2 * n[None, :] + 1) * v / 64)).sum() for v in range(8)] for u in range(8)])
    bits = (np.round(plain, 6) > np.median(np.round(plain, 6).ravel()[1:])).ravel()
    assert media.cosine_hash(image) == int("".join("01"[b] for b in bits.astype(int)), 2)
    noisy = np.clip(image.astype(int) + np.random.default_rng(0).integers(-3, 4, image.shape), 0, 255).astype(np.uint8)
    assert bin(media.cosine_hash(image) ^ media.cosine_hash(noisy)).count("1") <= 10


def test_documents_round_trip(spark):
    rows = awkward()
    docs = documents(spark, rows).withColumnRenamed("lang", "media")
    packed = media.pack(docs, "doc_id", "text")
    got = media.unpack(packed).collect()
    assert len(got) == len(rows)
    want = sorted(((t or "").encode() for _, t in rows))
    assert sorted(bytes(r.payload)[: r.n_bytes] for r in got) == want
    for r in got:
        assert r.error is None and len(r.payload) % 64 == 0 and len(r.payload) >= 64
    thin = {(r.id, r.payload_sha256) for r in media.unpack(packed, False).collect()}
    assert thin == {(r.id, hashlib.sha256(r.payload).hexdigest()) for r in got}
    bad = spark.createDataFrame([(1, 3, b"no image"), (2, 0, None)], "id bigint, n_bytes bigint, media binary")
    assert all(r.error and r.feature is None for r in media.unpack(bad).collect())
    assert media.unpack(media.pack(documents(spark, []), "doc_id", "text")).count() == 0
