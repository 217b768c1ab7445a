import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwave.llm import media

from .fixtures import frame, odd_rows


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=700))
def test_round_trip(raw):
    assert media.read_png(media.write_png(media.padded(raw)))[:, :, 0].tobytes() == media.padded(raw)


def test_damage_is_found():
    png = bytearray(media.write_png(media.padded(b"hello")))
    for at in (20, 45, len(png) - 3):
        bad = bytes(png[:at]) + bytes([png[at] ^ 1]) + bytes(png[at + 1 :])
        with pytest.raises((ValueError, zlib.error)):
            media.read_png(bad)
    with pytest.raises(ValueError):
        media.read_png(bytes(png[:-12]))


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("bpp", [1, 3])
def test_all_filters(kind, bpp):
    """Against the filters as they are written: each sample less its prediction."""
    rng = np.random.default_rng(kind)
    h, w = 9, 11
    image = rng.integers(0, 256, (h, w * bpp)).astype(int)
    lines = np.zeros_like(image)
    for y in range(h):
        for x in range(w * bpp):
            a = image[y, x - bpp] if x >= bpp else 0
            b = image[y - 1, x] if y else 0
            c = image[y - 1, x - bpp] if y and x >= bpp else 0
            p = a + b - c
            near = min(((abs(p - v), i, v) for i, v in enumerate((a, b, c))))[2]
            lines[y, x] = (image[y, x] - (0, a, b, (a + b) // 2, near)[kind]) % 256
    data = zlib.compress(np.c_[np.full(h, kind), lines].astype(np.uint8).tobytes())
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[bpp], 0, 0, 0)
    png = media.SIGNATURE + media.chunk(b"IHDR", head) + media.chunk(b"IDAT", data[:20]) + media.chunk(b"IDAT", data[20:]) + media.chunk(b"IEND", b"")
    assert (media.read_png(png).reshape(h, -1) == image).all()


def test_table(spark):
    got = media.store_media(frame(spark, odd_rows())).collect()
    for r, (_, t) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"])), sorted(odd_rows(), key=lambda x: (x[0] is None, x[0] or 0, len((x[1] or "").encode()))), strict=True):
        raw = media.padded((t or "").encode())
        assert r["payload_sha256"] == hashlib.sha256(raw).hexdigest() and r["tail_crc32"] == zlib.crc32(raw[-64:])
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and len(r["feature_bits"]) == 8


def test_similar_images_have_near_hashes():
    rng = np.random.default_rng(1)
    smooth = np.outer(np.linspace(0, 200, 64), np.linspace(0.2, 1, 64))
    a, b, c = (media.cosine_hash(np.clip(x, 0, 255)) for x in (smooth, smooth + rng.normal(0, 2, (64, 64)), rng.uniform(0, 255, (64, 64))))
    far = lambda x, y: bin(int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).count("1")
    assert far(a, b) < far(a, c)
