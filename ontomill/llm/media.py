"""Telephony audio: G.711 mu-law and A-law, IMA ADPCM blocks, resampling, and the WAVE container.

Companded samples are expanded by lookup tables of 256 entries, built from the laws' formulas. ADPCM is decoded with numpy
across blocks: one step in time at once for all blocks of a batch, as each block starts from its own header. PCM is 16 bits.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontomill.llm.columns import string_bytes, text_of
from ontomill.plans.rounds import checkpoint_dir
from ontomill.plans.ship import arrow_rows

RATE = 8000
UNIT = 192
#: WAVE format tags.
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17
# Fixed values of IMA ADPCM: the step sizes and the moves of the step index by the low three bits of a code.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442,
    11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    """16-bit PCM of each mu-law code: bits inverted, then sign, three bits of exponent, four of mantissa, bias 132."""
    u = ~np.arange(256) & 0xFF
    size = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit PCM of each A-law code: every second bit inverted, then sign, exponent and mantissa."""
    a = np.arange(256) ^ 0x55
    exponent, mantissa = a >> 4 & 7, (a & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, mantissa + 264 << np.maximum(exponent - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """16-bit PCM of mono IMA ADPCM blocks, one a row: a header of first sample and step index, then codes, low half first."""
    head = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(blocks[:, 2].astype(np.int32), 0, 88)
    codes = np.empty((blocks.shape[1] - 4) * 2 * len(blocks), np.uint8).reshape(-1, len(blocks))
    body = blocks[:, 4:].T
    codes[0::2], codes[1::2] = body & 15, body >> 4
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = head
    # the change that a code makes, for each step index: sign, then step/8 and step, step/2, step/4 by its bits
    code = np.arange(16)
    size = (STEPS[:, None] >> 3) + (code >> 2 & 1) * STEPS[:, None] + (code >> 1 & 1) * (STEPS[:, None] >> 1) + (code & 1) * (STEPS[:, None] >> 2)
    change = np.where(code & 8, -size, size).astype(np.int32).ravel()
    following = np.clip(np.arange(89)[:, None] + MOVES[code & 7], 0, 88).astype(np.int32).ravel()
    for k, c in enumerate(codes):
        at = index * 16 + c
        head = np.clip(head + change[at], -32768, 32767)
        index = following[at]
        out[k + 1] = head
    return out.T


def adpcm_encode(pcm: np.ndarray, block: int = UNIT) -> np.ndarray:
    """IMA ADPCM blocks of 16-bit PCM, encoded across blocks; the last block is filled with its last sample."""
    each = (block - 4) * 2 + 1
    if not len(pcm):
        return np.zeros((0, block), np.uint8)
    rows = -(-len(pcm) // each)
    x = np.concatenate([pcm, np.full(rows * each - len(pcm), pcm[-1], pcm.dtype)]).reshape(rows, each).astype(np.int32)
    out = np.zeros((rows, block), np.uint8)
    out[:, :2] = x[:, 0].astype("<i2").view(np.uint8).reshape(rows, 2)
    value, index = x[:, 0].copy(), np.zeros(rows, np.int32)
    for k in range(1, each):
        step = STEPS[index]
        d = x[:, k] - value
        code = np.where(d < 0, 8, 0)
        rest, size = np.abs(d), step >> 3
        for bit, shift in ((4, 0), (2, 1), (1, 2)):
            on = rest >= step >> shift
            code |= np.where(on, bit, 0)
            size = size + np.where(on, step >> shift, 0)
            rest = rest - np.where(on, step >> shift, 0)
        value = np.clip(value + np.where(code & 8, -size, size), -32768, 32767)
        index = np.clip(index + MOVES[code & 7], 0, 88)
        out[:, 4 + (k - 1) // 2] |= (code << 4 * ((k - 1) % 2)).astype(np.uint8)
    return out


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation from one sample rate to another, rounded to 16 bits."""
    if rate == to or len(pcm) < 2:
        return pcm.astype(np.int16)
    at = np.arange(len(pcm) * to // rate) * (rate / to)
    return np.rint(np.interp(at, np.arange(len(pcm)), pcm)).astype(np.int16)


def lift(pcm: np.ndarray) -> bytes:
    """16-bit PCM in a form that compresses better: the even samples, then how each odd one differs from the mean of its neighbours.

    One predicting step of an integer wavelet; differences wrap at 16 bits, so ``unlift`` gives back any samples.
    """
    even, odd = pcm[0::2].astype(np.int32), pcm[1::2].astype(np.int32)
    return even.astype("<i2").tobytes() + (odd - _between(even, len(odd))).astype("<i2").tobytes()


def unlift(stored: bytes) -> np.ndarray:
    """The PCM that ``lift`` took."""
    x = np.frombuffer(stored, "<i2")
    even, rest = x[: (len(x) + 1) // 2], x[(len(x) + 1) // 2 :]
    out = np.empty(len(x), np.int16)
    out[0::2] = even
    out[1::2] = (rest + _between(even.astype(np.int32), len(rest))).astype(np.int16)
    return out


def _between(even: np.ndarray, n: int) -> np.ndarray:
    """Means of the ``n`` first samples and their following ones (of the last: itself), halves rounded to even."""
    both = even[:n] + np.append(even[1:], even[-1:])[:n]
    down = both >> 1
    return down + (both & down & 1)


def wave_bytes(tag: int, payload: bytes, rate: int = RATE) -> bytes:
    """A mono WAVE file: 8-bit companded samples, ADPCM blocks of ``UNIT`` bytes, or 16-bit PCM."""
    bits, align = {PCM: (16, 2), IMA_ADPCM: (4, UNIT)}.get(tag, (8, 1))
    per_second = rate * align // (((UNIT - 4) * 2 + 1) if tag == IMA_ADPCM else 1)
    extra = struct.pack("<HH", 2, (UNIT - 4) * 2 + 1) if tag == IMA_ADPCM else b"" if tag == PCM else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", tag, 1, rate, per_second, align, bits) + extra
    pad = b"\0" * (len(payload) & 1)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(stored: bytes) -> tuple[int, int, bytes]:
    """Format tag, sample rate and payload of a WAVE file; raises ValueError for anything else."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(stored):
        name, n = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", stored, at + 8)
        elif name == b"data":
            return tag, rate, stored[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("a WAVE file without data")


def pcm_of(stored: bytes, to: int | None = None, tables: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The PCM of a stored telephony file, resampled to ``to`` if given."""
    tag, rate, payload = read_wave(stored)
    raw = np.frombuffer(payload, np.uint8)
    mu, a = tables or (mulaw_table(), alaw_table())
    if tag == MULAW:
        pcm = mu[raw]
    elif tag == ALAW:
        pcm = a[raw]
    elif tag == IMA_ADPCM:
        pcm = adpcm_decode(raw[: len(raw) // UNIT * UNIT].reshape(-1, UNIT)).ravel()
    elif tag == PCM:
        pcm = raw[: len(raw) // 2 * 2].view("<i2")
    else:
        raise ValueError(f"format tag {tag}")
    return resample(pcm, rate, to) if to else pcm


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """The bytes with spaces up to a positive multiple of ``unit``."""
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b" ")


def _parts(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes in a column, or one row."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def _feature_batch(payloads: list[bytes], wide: list[bytes], tables: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """Of each payload, as text: root mean squares as mu-law and as A-law, the decoded ADPCM's mean square and crossings, and a checksum of the PCM at twice the rate (``wide``, as ``lift`` left it)."""
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    sizes = np.array([len(p) for p in payloads])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mu, a = tables[0][raw], tables[1][raw]
    squares = [np.add.reduceat(x.astype(np.float64) ** 2, starts) for x in (mu, a)]
    blocks, block_starts = raw.reshape(-1, UNIT), starts // UNIT
    each, crossings = np.empty(len(blocks)), np.empty(len(blocks), np.int64)
    for at in range(0, len(blocks), 8192):
        pcm = adpcm_decode(blocks[at : at + 8192])
        each[at : at + 8192] = (pcm.astype(np.float64) ** 2).sum(1)
        crossings[at : at + 8192] = ((pcm[:, 1:] < 0) != (pcm[:, :-1] < 0)).sum(1)
    adpcm, crossed = np.add.reduceat(each, block_starts), np.add.reduceat(crossings, block_starts)
    out = []
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        n = e - s
        decoded = n // UNIT * ((UNIT - 4) * 2 + 1)
        out.append(f"mulaw_rms={np.sqrt(squares[0][i] / n):.3f};alaw_rms={np.sqrt(squares[1][i] / n):.3f};adpcm_rms={np.sqrt(adpcm[i] / decoded):.3f};adpcm_crossings={crossed[i]};pcm16k_crc32={zlib.crc32(unlift(wide[i]).astype('<i2').tobytes())}")
    return out


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pcm: bool = True, lifted: bool = False) -> DataFrame:
    """``id, n_bytes, media`` and, if asked for, ``pcm16k``: each text as a mu-law file, and its PCM at twice the rate (``lifted``: in the form of ``lift``); null counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = mulaw_table(), alaw_table()
        for batch in batches:
            for part in _parts(batch, 1, 1 << 20):
                data = string_bytes(part.column(1))
                media = [wave_bytes(MULAW, padded(x)) for x in data]
                columns = [part.column(0), pa.array(list(map(len, data)), pa.int64()), pa.array(media, pa.binary())]
                if pcm:
                    wide = (pcm_of(m, 2 * RATE, tables) for m in media)
                    columns.append(pa.array([lift(x) if lifted else x.astype("<i2").tobytes() for x in wide], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "media", "pcm16k"][: len(columns)])

    return arrow_rows(docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("t")), rows, f"id {kind}, n_bytes long, media binary" + (", pcm16k binary" if pcm else ""))


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4 << 20, folder: str | None = None) -> DataFrame:
    """What is read back from each text's stored form, and features of it; equal texts give equal values.

    The files and their PCM at twice the rate are written as Parquet columns, compressed by Zstandard, to a new folder below
    ``folder`` (by default that of the session's checkpoints), and read again. The PCM is stored lifted, without loss, as it
    would take 1.3 x the input otherwise; the feature that sums it up is made from what was read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    at = f"{folder or checkpoint_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    # a page is compressed by itself: larger ones find more repeats
    how = {"compression": "zstd", "parquet.compression.codec.zstd.level": 6, "parquet.page.size": 4 << 20}
    store_texts(docs, id_col, text_col, lifted=True).write.options(**how).parquet(at)
    stored = docs.sparkSession.read.schema(f"id {kind}, n_bytes long, media binary, pcm16k binary").parquet(at)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = mulaw_table(), alaw_table()
        for batch in batches:
            for part in _parts(batch, 2, batch_bytes):
                media, wide = part.column(2).to_pylist(), part.column(3).to_pylist()
                back = [read_wave(m)[2] for m in media]
                columns = [part.column(0), part.column(1), pa.array(list(map(len, back)), pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in back]), pa.array([zlib.crc32(p[-16:]) for p in back], pa.int64()), pa.array(list(map(len, media)), pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array(_feature_batch(back, wide, tables))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return arrow_rows(stored, rows, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
