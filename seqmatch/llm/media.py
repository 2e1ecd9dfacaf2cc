"""Media columns: texts or samples as lossless WebP images in a binary column, and back as pixel arrays."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webpbatch
from .common import blocks, free_names, materialize, text_buffer, without

UNIT = 576
ROWS = 32
_FLUSH = 1 << 24
_MEMORY = 96 << 20


def to_images(payloads: list[bytes], rows: int = ROWS) -> list[bytes]:
    """Each payload, of a positive multiple of UNIT bytes, as images of UNIT / 3 pixels across, one after the other.

    Three bytes are the red, green and blue samples of a pixel.  An image holds up to ``rows`` rows; a longer payload has
    several, so its memory and the steps of the codec are bounded however long it is."""
    raw = [np.frombuffer(p, np.uint8) for p in payloads]
    parts = [(i, x[a : a + rows * UNIT]) for i, x in enumerate(raw) for a in range(0, len(x), rows * UNIT)]
    parts.sort(key=lambda p: -len(p[1]))  # ties keep their order
    made: dict[int, list[bytes]] = {i: [] for i in range(len(payloads))}
    for a, b in _groups([60 * len(x) + (1 << 16) for _, x in parts]):
        for (i, _), image in zip(parts[a:b], webpbatch.Batch([x for _, x in parts[a:b]], UNIT // 3).encode(), strict=True):
            made[i].append(image)
    return [b"".join(made[i]) for i in range(len(payloads))]


def _groups(sizes: list[int]) -> list[tuple[int, int]]:
    """Ranges of images whose needs of memory, estimated in bytes, sum to _MEMORY or that are one image."""
    return blocks(np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]), _MEMORY)


def images(media: bytes) -> Iterator[bytes]:
    """The files of a stored form, by the sizes in their headers."""
    at = 0
    while at < len(media):
        size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        yield media[at : at + size]
        at += size


def from_images(stored: list[bytes]) -> list[np.ndarray]:
    """For each stored form the samples (height, UNIT) of all its images, one below the other."""
    files = [(i, x) for i, m in enumerate(stored) for x in images(m)]
    order = sorted(range(len(files)), key=lambda k: -webpbatch.pixels_of(files[k][1]))
    pixels: list[np.ndarray | None] = [None] * len(files)
    for a, b in _groups([16 * len(files[k][1]) + (1 << 14) for k in order]):
        for k, px in zip(order[a:b], webpbatch.decode([files[k][1] for k in order[a:b]]), strict=True):
            flat = np.empty((*px.shape, 3), np.uint8)
            flat[..., 0], flat[..., 1], flat[..., 2] = px >> np.uint32(16) & np.uint32(255), px >> np.uint32(8) & np.uint32(255), px & np.uint32(255)
            pixels[k] = flat.reshape(len(px), -1)
    found: list[list[np.ndarray]] = [[] for _ in stored]
    for (i, _), px in zip(files, pixels, strict=True):
        found[i].append(px)
    return [np.concatenate(x) if len(x) != 1 else x[0] for x in found]


def describe(pixels: np.ndarray) -> str:
    """Size, mean, spread and an 8-bin histogram of samples, as text."""
    counts = np.bincount(pixels.ravel() >> 5, minlength=8)
    return f"{pixels.shape[1]}x{pixels.shape[0]};{pixels.mean():.4f};{pixels.std():.4f};{','.join(map(str, counts.tolist()))}"


def _by_size(batches: Iterator[pa.RecordBatch], column: int, grow: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose texts sum to _FLUSH / grow bytes or are one row."""
    for batch in batches:
        _, at = text_buffer(batch.column(column))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(at, at[a] + _FLUSH // grow, side="right")) - 1)
            b = min(b, batch.num_rows)
            yield batch.slice(a, b - a)
            a = b


def store(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs``, n_bytes, and ``media``: the text's UTF-8 padded with 255 to a positive
    multiple of 576 and stored as lossless images.

    A null text counts as empty and has 576 bytes of padding.  Equal texts have equal media, and are encoded once a
    slice of rows.  A very long text is several images.  Input columns named n_bytes or media are replaced; all others,
    however named, pass through.
    """
    docs = without(docs, "n_bytes", "media")
    keep = [c for c in docs.columns if c != "text"] if keep is None else keep
    own = free_names(docs, "__text")[0]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("text", F.lit("")).cast("binary").alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_size(batches, len(keep), 1):
            texts = batch.column(len(keep)).to_pylist()
            made = {t: t + b"\xff" * (-len(t) % UNIT if t else UNIT) for t in texts}
            made = dict(zip(made, to_images(list(made.values())), strict=True))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array([len(t) for t in texts], pa.int64()), pa.array([made[t] for t in texts], pa.binary())], names=[*keep, "n_bytes", "media"])

    return rows.mapInArrow(run, rows.drop(own).schema.add("n_bytes", "long").add("media", "binary"))


def load(media: DataFrame, pixels: bool = True) -> DataFrame:
    """Decode the column ``media``: its other columns, and width, height, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, and, if asked for, the pixels in row order."""
    keep = [c for c in media.columns if c != "media"]
    rows = media.select(*[F.col(f"`{c}`") for c in keep], "media")
    schema = rows.drop("media").schema
    for name, kind in (("width", "integer"), ("height", "integer"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"), *([("pixels", "binary")] if pixels else [])):
        schema = schema.add(name, kind)
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_size(batches, len(keep), 4):
            stored = batch.column(len(keep)).to_pylist()
            different = list(dict.fromkeys(stored))
            made = {}
            for m, p in zip(different, from_images(different), strict=True):
                raw = p.tobytes()
                made[m] = (p.shape[1], p.shape[0], len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(m), hashlib.sha256(m).hexdigest(), describe(p), *([raw] if pixels else []))
            columns = list(zip(*(made[m] for m in stored), strict=True))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *[pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]], names=schema.names)

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, keep: list[str], pixels: bool = False) -> DataFrame:
    """Store the texts as a media column in the shared folder, read it back and decode it."""
    return load(materialize(store(docs, keep), "media"), pixels)
