"""PNG media columns: lossless storage of bytes as 8-bit grey images, checked reading, and cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
#: Side of the image that is transformed, and of its low-frequency corner that becomes the hash.
SIDE, LOW = 32, 8


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """Bytes as a grey image of rows of width samples. Each row takes the cheapest of the filters none, sub and up."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    cost = np.stack([np.minimum(x, 0 - x).sum(1, dtype=np.int64) for x in (rows, sub, up)])
    kind = cost.argmin(0).astype(np.uint8)
    lines = np.where((kind == 1)[:, None], sub, np.where((kind == 2)[:, None], up, rows))
    data = zlib.compress(np.c_[kind, lines].tobytes(), level)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", data) + chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The chunks of a PNG file, each checked against its checksum."""
    if png[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while at + 12 <= len(png):
        (n,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if len(data) < n or png[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError(f"chunk {kind!r} is damaged")
        yield kind, data
        at += 12 + n
        if kind == b"IEND":
            return
    raise ValueError("the file ends before its end chunk")


def unfilter(kind: np.ndarray, lines: np.ndarray, bpp: int) -> np.ndarray:
    """Filtered rows back to samples. Runs of rows with the filters none, sub and up are taken at once."""
    out = lines.copy()
    sub = kind == 1
    if sub.any():
        n = int(sub.sum())
        out[sub] = np.cumsum(lines[sub].reshape(n, -1, bpp), axis=1, dtype=np.uint8).reshape(n, -1)
    begin = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    for a, b in zip(begin, np.r_[begin[1:], len(kind)], strict=True):
        if kind[a] == 2:
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif kind[a] in (3, 4):
            for r in range(a, b):
                above = out[r - 1] if r else np.zeros_like(out[r])
                out[r] = _row(lines[r], above, bpp, kind[a] == 4)
        elif kind[a] > 4:
            raise ValueError(f"filter {kind[a]}")
    return out


def _row(line: np.ndarray, above: np.ndarray, bpp: int, paeth: bool) -> list[int]:
    """A row under the average or the Paeth filter, whose samples lean on each other."""
    done, up = [0] * bpp, [0] * bpp + above.tolist()
    for x, v in enumerate(line.tolist()):
        left, b, c = done[x], up[x + bpp], up[x]
        if paeth:
            p = left + b - c
            near = min((abs(p - left), 0, left), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        else:
            near = (left + b) // 2
        done.append((v + near) & 255)
    return done[bpp:]


def read_png(png: bytes) -> np.ndarray:
    """Samples (height x width x channels) of a non-interlaced 8-bit PNG without palette."""
    parts: dict[bytes, list[bytes]] = {}
    for kind, data in chunks(png):
        parts.setdefault(kind, []).append(data)
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", parts[b"IHDR"][0])
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlace or not channels:
        raise ValueError("only 8-bit grey or true-colour images without interlace")
    rows = np.frombuffer(zlib.decompress(b"".join(parts[b"IDAT"])), np.uint8).reshape(height, 1 + width * channels)
    return unfilter(rows[:, 0], rows[:, 1:], channels).reshape(height, width, channels)


_COS = np.cos(np.pi * (2 * np.arange(SIDE) + 1) * np.arange(LOW)[:, None] / (2 * SIDE))


def box_mean(samples: np.ndarray, side: int = SIDE) -> np.ndarray:
    """A grey image averaged down to side x side cells; smaller images repeat samples."""
    for axis in (0, 1):
        n = samples.shape[axis]
        at = np.arange(side) * n // side
        sizes = np.maximum(np.diff(np.r_[at, n]), 1).reshape((-1, 1) if axis == 0 else (1, -1))
        samples = np.add.reduceat(samples.astype(np.float64), at, axis=axis) / sizes
    return samples


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which low-frequency cosine coefficients of the 32 x 32 image exceed their median (the mean's is left out of it)."""
    low = _COS @ box_mean(samples) @ _COS.T
    flat = np.round(low.ravel(), 6)
    return np.packbits(flat > np.median(flat[1:])).tobytes()


def padded(raw: bytes) -> bytes:
    """raw with bytes 0 up to a positive multiple of WIDTH."""
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0")


def store_media(docs: DataFrame, text: str = "text", with_media: bool = True) -> DataFrame:
    """Each document's text as a PNG, and what its stored bytes say when read back.

    Returns doc_id, n_bytes (unpadded UTF-8), media (the PNG; left out without with_media), media_bytes, media_sha256,
    payload_bytes, payload_sha256, tail_crc32 (of the last 64 payload bytes), feature_bits (binary cosine hash). The
    payload figures come from the file as read, each chunk checked. A null or empty text is stored as 64 bytes 0. Equal
    texts give equal rows; repeated rows, ties and null doc_id keep theirs; an empty table gives an empty one; texts
    have no limit; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            files = [write_png(padded(r)) for r in raw]
            images = [read_png(f)[:, :, 0] for f in files]
            back = [i.tobytes() for i in images]
            out = {"doc_id": batch.column(0), "n_bytes": pa.array(map(len, raw), pa.int64())}
            if with_media:
                out["media"] = pa.array(files, pa.binary())
            out |= {
                "media_bytes": pa.array(map(len, files), pa.int64()),
                "media_sha256": pa.array(hashlib.sha256(f).hexdigest() for f in files),
                "payload_bytes": pa.array(map(len, back), pa.int64()),
                "payload_sha256": pa.array(hashlib.sha256(b).hexdigest() for b in back),
                "tail_crc32": pa.array((zlib.crc32(b[-64:]) for b in back), pa.int64()),
                "feature_bits": pa.array([cosine_hash(i) for i in images], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, n_bytes long, " + "media binary, " * with_media
    return docs.select("doc_id", text).mapInArrow(lean(run), columns + "media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature_bits binary")
