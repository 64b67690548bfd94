"""Media columns: texts kept as progressive JPEGs, and JPEGs read back as RGB tensors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import jpeg


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column("doc_id"), b.column("text").to_pylist()
        for i in range(0, len(texts), 256):  # a few at a time: a batch of long texts would be large
            media = [jpeg.encode((t or "").encode("utf-8", "surrogatepass")) for t in texts[i : i + 256]]
            yield pa.RecordBatch.from_arrays([ids.slice(i, len(media)), pa.array(media, pa.binary())], ["doc_id", "media"])


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text's bytes as the coefficients of a progressive JPEG; null as an empty text.  Equal texts give
    equal media, row by row; other columns count for nothing; an empty table gives an empty result."""
    return docs.select("doc_id", "text").mapInArrow(_encode, "doc_id long, media binary")


def feature(rgb: np.ndarray) -> str:
    """Size and mean of each channel."""
    mean = [int(rgb[:, :, k].sum(dtype=np.int64)) / (rgb.shape[0] * rgb.shape[1]) for k in range(3)]
    return f"{rgb.shape[0]}x{rgb.shape[1]}:" + ",".join(f"{m:.3f}" for m in mean)


def _tensors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, m in enumerate(b.column("media").to_pylist()):
            shape, rgb, error = (None, None), None, None
            if m is not None:
                try:
                    image = jpeg.Image(m).rgb()
                    shape, rgb = image.shape[:2], image.tobytes()
                except Exception as e:  # a broken stream can fail anywhere
                    error = f"{type(e).__name__}: {e}"
            cols = [pa.array([shape[0]], pa.int32()), pa.array([shape[1]], pa.int32()), pa.array([rgb], pa.binary()), pa.array([error], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 1), *cols], ["doc_id", "height", "width", "rgb", "error"])


def tensors(media: DataFrame) -> DataFrame:
    """(doc_id, height, width, rgb, error): full-resolution tensors of height * width * 3 bytes, of any progressive JPEG in
    media (doc_id, media), to be written as they are, with restart markers or without.  Null media gives nulls; a broken stream
    gives nulls and what is wrong with it.  Repeated rows stay; an empty table gives an empty result."""
    return media.select("doc_id", "media").mapInArrow(_tensors, "doc_id long, height int, width int, rgb binary, error string")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for m in b.column("media").to_pylist():
            image = jpeg.Image(m)
            payload, n = image.stored()
            rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(image.rgb())))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def digest(media: DataFrame) -> DataFrame:
    """What the stored bytes hold, read back: payload, its end, the stored form, and a feature of the RGB tensor."""
    return media.mapInArrow(_digest, DIGEST)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    return digest(store(docs))
