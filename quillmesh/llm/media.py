"""Operator 7, media columns: texts as 8-bit WAV, read back by the wave module, with spectral-peak pair fingerprints.

The sounds are written as a binary column; all that is told of them is worked out from what is read back.

Edge cases: a null text counts as empty; an empty text is one payload of 64 zero bytes; equal texts give equal rows;
rows are independent, so repeated rows, ties and extra columns need no care; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import lean, shared_dir, small_batches, stash, table

BLOCK = 64
RATE = 8000
FRAME, HOP, BANDS, REACH = 512, 256, 4, 2
#: Sounds of so few samples are looked at in smaller hops.
SHORT = 1024
#: Frames transformed at once; bounds memory for long sounds.
AT_ONCE = 2048


def pad(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of BLOCK."""
    return data + b"\0" * (BLOCK - len(data) % BLOCK if len(data) % BLOCK or not data else 0)


def to_wav(payload: bytes) -> bytes:
    """payload as the samples of a mono 8-bit WAV file."""
    with io.BytesIO() as out:
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(RATE)
            w.writeframes(payload)
        return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file."""
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Pairs of spectral peaks as time-coded longs: frame << 32 | band << 24 | first bin << 16 | second bin << 8 | distance.

    The frames start a hop before the sound and end after it, so each sample lies in two of them. Each frame's strongest bin
    in each band is a peak if it is above the band's mean by half; a peak pairs with those of the same band in the next REACH
    frames. The strongest bins of two bands of one frame pair too, at distance 0 and with (band + 1) << 4 | second band as
    their band, so that the shortest sound has pairs. Sounds of up to SHORT samples have eight times as many frames.
    """
    hop = HOP if len(samples) > SHORT else HOP // 8
    count = HOP // hop - (-len(samples) // hop)
    x = np.full((count - 1) * hop + FRAME, 128, np.uint8)
    x[HOP : HOP + len(samples)] = samples
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::hop]
    window, width = np.hanning(FRAME).astype(np.float32), FRAME // 2 // BANDS
    bins, loud = np.empty((count, BANDS), np.int64), np.empty((count, BANDS), bool)
    for i in range(0, count, AT_ONCE):
        part = (frames[i : i + AT_ONCE].astype(np.float32) - 128) * window
        power = np.abs(np.fft.rfft(part, axis=1)[:, 1:]).reshape(len(part), BANDS, width)
        bins[i : i + AT_ONCE] = power.argmax(axis=2)
        loud[i : i + AT_ONCE] = power.max(axis=2) > 1.5 * power.mean(axis=2)
    found = [np.arange(count) << 32 | ((a + 1) << 4 | b) << 24 | bins[:, a] << 16 | bins[:, b] << 8 for a in range(BANDS) for b in range(a + 1, BANDS)]
    for d in range(1, REACH + 1):
        t, band = np.nonzero(loud[:-d] & loud[d:]) if count > d else (np.zeros(0, np.int64),) * 2
        found.append(t << 32 | band << 24 | bins[t, band] << 16 | bins[t + d, band] << 8 | d)
    return np.sort(np.concatenate(found))


OUT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, peaks array<long>"


def stored(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, n_bytes, media): each row's text as a WAV file; a media column to be written."""
    small_batches(df.sparkSession)
    kinds = dict(df.dtypes)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(v.as_py() or "").encode() for v in b.column(b.num_columns - 1)]
            made = [pa.array([len(t) for t in texts], pa.int64()), pa.array([to_wav(pad(t)) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*keep, "n_bytes", "media"])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["n_bytes long, media binary"]))


def features(media: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, sizes, digests, fingerprint and its digest) of a media column as stored wrote it.

    No shuffle; the memory of a task is a batch of sounds and one sound's frames.
    """
    kinds = dict(media.dtypes)
    types = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in OUT.split(", ")][1:]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for v in b.column(b.num_columns - 1):
                sound = v.as_py()
                back = from_wav(sound)
                peaks = fingerprint(np.frombuffer(back, np.uint8))
                feature = f"{len(peaks)}:{hashlib.sha256(peaks.astype('<i8').tobytes()).hexdigest()[:32]}"
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(sound), hashlib.sha256(sound).hexdigest(), feature, peaks))
            made = [pa.array(list(c), types[t]) for (_, t), c in zip(fields, zip(*rows) if rows else [[]] * len(fields), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=[*keep, *[n for n, _ in [["n_bytes", ""], *fields]]])

    return media.select(*[F.col(f"`{c}`") for c in keep], "n_bytes", "media").mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [OUT]))


def media_columns(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), store: bool = False) -> DataFrame:
    """Each row's text as a sound: written, read back, and described; with store the column media too. keep must not name an output column."""
    shared_dir(df.sparkSession)
    written = stash(stored(df, text, keep), "zstd")
    if not store:
        return features(written, keep)
    small = {c: f"_{i}" for i, c in enumerate(keep)}
    both = written.select(*[F.col(f"`{c}`").alias(n) for c, n in small.items()], "n_bytes", "media", F.col("media").alias("_media"))
    return features(both, (*small.values(), "_media")).withColumnsRenamed({n: c for c, n in small.items()} | {"_media": "media"})


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
