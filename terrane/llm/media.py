"""Media columns: texts' bytes stored as lossless WebP images, read back, and described.

A payload of a multiple of 64 bytes is laid out in rows of 16 pixels of four 8-bit samples. A
document of more than FRAME bytes becomes an animation, whose frames are coded on their own, so
that one long document is as cheap a byte as many short ones.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrane.llm import webp
from terrane.llm.common import byte_chunks, doc_texts

UNIT = 64
FRAME = 8192
WIDTH = UNIT // 4
BATCH = 4 << 20


def payload(text: str) -> bytes:
    """The text's UTF-8 and bytes 0 up to a positive multiple of 64."""
    raw = text.encode("utf-8", "replace")
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def to_media(payloads: list[bytes]) -> list[bytes]:
    """A WebP file for each payload."""
    frames = [np.frombuffer(p[k : k + FRAME], "<u4") for p in payloads for k in range(0, len(p), FRAME)]
    streams = iter(webp.encode_streams(frames, WIDTH) if frames else [])
    return [webp.container([(next(streams), WIDTH, len(p[k : k + FRAME]) // UNIT) for k in range(0, len(p), FRAME)]) for p in payloads]


def from_media(files: list[bytes]) -> tuple[list[bytes], list[str]]:
    """The pixel arrays' bytes of WebP files, decoded, and what the streams are made with."""
    streams = [webp.streams_of(f) for f in files]
    images = iter(webp.decode_streams([s for own in streams for s in own]))
    out, made = [], []
    for own in streams:
        frames = [next(images) for _ in own]
        out.append(b"".join(im.pixels.astype("<u4").tobytes() for im in frames))
        kinds = sorted({("predictor", "cross-colour", "green", "palette")[t[0]] for im in frames for t in im.transforms})
        made.append(f"webp:{WIDTH}x{sum(im.height for im in frames)}:{len(frames)}:{'+'.join(kinds) or 'plain'}")
    return out, made


def feature(data: bytes) -> str:
    """16 means, of the samples of the pixel columns, as two hexadecimal digits each."""
    return bytes(np.frombuffer(data, np.uint8).reshape(-1, WIDTH, 4).mean((0, 2)).round().astype(np.uint8)).hex()


def store(docs: DataFrame) -> DataFrame:
    """doc_id and media (binary): each whole text's WebP file."""

    def run(batches):
        for b in batches:
            for c in byte_chunks(b, "text", BATCH):
                files = to_media([payload(t) for t in c.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(files, pa.binary())], ["doc_id", "media"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, media binary")


def describe(docs: DataFrame) -> DataFrame:
    """Stores each whole text as a WebP file, reads the file's pixels back, and describes both.

    Columns: doc_id, n_bytes (of the text), payload_bytes, payload_sha256 and tail_crc32 (of the
    last 64 bytes; all of what was read back), media_bytes, media_sha256, feature, and made (size,
    frames, transforms). A null or empty text is 64 bytes 0. Equal texts give equal values, repeated
    rows each a row, an empty table none; a long text has as many frames as it needs; other columns are
    left out.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, made string"

    def run(batches):
        for b in batches:
            for c in byte_chunks(b, "text", BATCH):
                texts = c.column("text").to_pylist()
                files = to_media([payload(t) for t in texts])
                data, made = from_media(files)
                cols = [
                    c.column("doc_id"),
                    pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64()),
                    pa.array([len(d) for d in data], pa.int64()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string()),
                    pa.array([zlib.crc32(d[-UNIT:]) for d in data], pa.int64()),
                    pa.array([len(f) for f in files], pa.int64()),
                    pa.array([hashlib.sha256(f).hexdigest() for f in files], pa.string()),
                    pa.array([feature(d) for d in data], pa.string()),
                    pa.array(made, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in schema.split(", ")])

    return doc_texts(docs).mapInArrow(run, schema)
