"""Telephony audio columns: G.711 and ADPCM in WAVE containers.

Mu-law and A-law expand through 256-entry lookup tables.  IMA ADPCM is
sequential inside a block, so blocks of all rows at hand are decoded side by
side: one numpy step per sample position, each over every block.  Resampling is
a polyphase windowed sinc in 15-bit fixed point, so results do not depend on
how rows are batched.  Resampled audio is stored as 16-bit PCM.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseline.llm.text_scan import slices, strings
from verseline.llm.tables import bound_batches, lean

#: fixed values: WAVE format tags
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17
#: fixed values: the IMA ADPCM index adjustments; its 89 step sizes grow by a tenth from 7 to 32767
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
STEP_SIZES = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
PAD = 64
RATE = 8000
#: rates of samples that are read; others are taken for damage
LEAST_RATE, MOST_RATE = 1000, 384_000


def mulaw_table() -> np.ndarray:
    """Mu-law code to 16-bit sample."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """A-law code to 16-bit sample."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    low, high = (code & 15) << 4, (code >> 4) & 7
    size = np.where(high == 0, low + 8, (low + 264) << np.maximum(high - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM blocks (n, bytes) to samples (n, 2 * bytes - 7); a step index beyond 88 reads as 88."""
    n, width = blocks.shape
    if width < 5:
        raise ValueError("an ADPCM block has 4 bytes of header and at least one of data")
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    out[0] = value
    codes = np.empty((2 * (width - 4), n), np.uint8)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    for i, code in enumerate(codes):
        step = STEP_SIZES[index]
        delta = step >> 3
        delta += (step >> 2) * (code & 1)
        delta += (step >> 1) * ((code >> 1) & 1)
        delta += step * ((code >> 2) & 1)
        value += np.where(code & 8, -delta, delta)
        np.clip(value, -32768, 32767, out=value)
        index += INDEX_STEPS[code]
        np.clip(index, 0, 88, out=index)
        out[i + 1] = value
    return out.T


def wave(data: bytes, kind: int, rate: int, block: int = 1, bits: int = 8, per_block: int = 0) -> bytes:
    """A mono WAVE file around encoded samples."""
    average = rate * block // max(1, per_block or 1)
    extra = struct.pack("<H", per_block) if kind == IMA_ADPCM else b""
    form = struct.pack("<HHIIHH", kind, 1, rate, average, block, bits) + (b"" if kind == PCM else struct.pack("<H", len(extra)) + extra)
    samples = len(data) // block * (per_block or 1)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form
    if kind != PCM:
        body += b"fact" + struct.pack("<II", 4, samples)
    body += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wave(media: bytes) -> tuple[int, int, int, memoryview]:
    """(format tag, rate, block size, encoded samples) of a mono WAVE file; ValueError if it is none."""
    view = memoryview(media)
    if len(view) < 12 or view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("no WAVE file")
    at, form = 12, None
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if name == b"fmt ":
            if size < 16 or at + 24 > len(view):
                raise ValueError("damaged WAVE file")
            form = struct.unpack_from("<HHIIHH", view, at + 8)
            if form[1] != 1:
                raise ValueError("only mono is supported")
            if not LEAST_RATE <= form[2] <= MOST_RATE:
                raise ValueError(f"rate of {form[2]}")
        elif name == b"data":
            if form is None or at + 8 + size > len(view):
                raise ValueError("damaged WAVE file")
            return form[0], form[2], form[4], view[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def decode(media: bytes) -> tuple[np.ndarray, int]:
    """16-bit samples and rate of a mono WAVE file in mu-law, A-law, IMA ADPCM or 16-bit PCM."""
    kind, rate, block, data = parse_wave(media)
    raw = np.frombuffer(data, np.uint8)
    if kind == MULAW:
        return MULAW_PCM[raw], rate
    if kind == ALAW:
        return ALAW_PCM[raw], rate
    if kind == PCM and block == 2:
        if len(raw) % 2:
            raise ValueError("half a sample")
        return raw.view("<i2"), rate
    if kind == IMA_ADPCM:
        if block < 5:
            raise ValueError(f"ADPCM blocks of {block} bytes")
        return adpcm_blocks(raw[: len(raw) // block * block].reshape(-1, block)).reshape(-1), rate
    raise ValueError(f"unknown format {kind}")


HALF = 8


@lru_cache
def _filter(up: int, down: int) -> np.ndarray:
    """Polyphase taps (up, 2 * HALF) in 15-bit fixed point; each phase sums to 1."""
    band = min(1.0, up / down)
    at = np.arange(2 * HALF)[None, :] - HALF + 1 - np.arange(up)[:, None] / up
    taps = band * np.sinc(band * at) * (0.54 + 0.46 * np.cos(np.pi * at / (HALF + 1)))
    taps = np.rint(taps / taps.sum(axis=1, keepdims=True) * 32768).astype(np.int64)
    taps[:, HALF - 1] += 32768 - taps.sum(axis=1)
    return taps


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """16-bit samples at another rate; ceil(n * to / rate) of them."""
    ratio = Fraction(to, rate)
    up, down = ratio.numerator, ratio.denominator
    if up == down or not len(pcm):
        return pcm.astype(np.int16)
    n = -(-len(pcm) * up // down)
    padded = np.zeros(len(pcm) + 2 * HALF + 1, np.int32)
    padded[HALF - 1 : HALF - 1 + len(pcm)] = pcm
    out = np.empty(n, np.int16)
    taps = _filter(up, down).astype(np.int32)
    for first in range(min(up, n)):
        phase, start = first * down % up, first * down // up
        count = len(range(first, n, up))
        total = np.full(count, 1 << 14, np.int64)
        for k, tap in enumerate(taps[phase].tolist()):
            if tap:
                total += padded[start + k : start + k + (count - 1) * down + 1 : down].astype(np.int64) * tap
        out[first::up] = np.clip(total >> 15, -32768, 32767)
    return out


def store_text_audio(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, zero-padded to a positive multiple of 64, as
    the mu-law samples of a WAVE file.  A null text is stored as an empty one (64 zero bytes)."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for lo, hi in slices(offsets):
                edges = offsets[lo : hi + 1].tolist()
                media = []
                for a, b in zip(edges[:-1], edges[1:]):
                    n = b - a
                    media.append(wave(data[a:b].tobytes() + b"\0" * (max(PAD, -(-n // PAD) * PAD) - n), MULAW, RATE))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets[lo : hi + 1])), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, media binary")


AUDIO_SCHEMA = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def read_audio(stored: DataFrame, rate: int = 16000, keep_pcm: bool = False) -> DataFrame:
    """Reads media back: digests of the stored samples, a feature string, error, and if asked a column pcm: the audio
    resampled to ``rate``, stored as a WAVE file of 16-bit PCM.

    feature: samples, RMS, peak and zero crossings of the expanded audio, the RMS of the same bytes under A-law
    and as 64-byte ADPCM blocks, and the CRC-32 of the resampled PCM.
    A null or empty media value gives nulls; one that cannot be read (no WAVE file, damaged, more channels than one,
    an unknown format) gives nulls and says why in ``error``.  Repeated rows stay; an empty table gives an empty
    table.  Columns of ``stored`` that clash with the new ones are left out.
    """
    bound_batches(stored.sparkSession)
    added = [c.split()[0] for c in AUDIO_SCHEMA.split(", ")] + ["pcm"] * keep_pcm
    kept = [f for f in stored.schema.fields if f.name.lower() not in ("media", *added)]
    names = [f.name for f in kept]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + AUDIO_SCHEMA + (", pcm binary" if keep_pcm else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(batch.schema.names.index("media")))
            for lo, hi in slices(offsets):
                rows = [_features(data[a:b].tobytes(), rate, keep_pcm) for a, b in zip(offsets[lo:hi].tolist(), offsets[lo + 1 : hi + 1].tolist())]
                _adpcm_levels(rows)
                columns = [batch.column(batch.schema.names.index(c)).slice(lo, hi - lo) for c in names]
                columns += [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))]
                if keep_pcm:
                    columns.append(pa.array([r[7] for r in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    return stored.select(*(F.col(f"`{c}`") for c in names), "media").mapInArrow(lean(run), schema)


def _rms(pcm: np.ndarray) -> float:
    wide = pcm.astype(np.int64)
    return float(np.sqrt(int(wide @ wide) / max(1, len(pcm))))


#: what a row without media has: six columns, error, PCM and raw samples
NOTHING = [None] * 9


def _features(media: bytes, rate: int, keep_pcm: bool) -> list:
    if not media:
        return NOTHING
    try:
        _, source_rate, _, samples = parse_wave(media)
        pcm, _ = decode(media)
    except ValueError as e:
        return [None] * 6 + [str(e), None, None]
    sign = pcm >= 0
    wide = resample(pcm, source_rate, rate)
    out = wide.astype("<i2").tobytes()
    raw = bytes(samples)
    feature = f"n={len(pcm)};rms={_rms(pcm):.3f};peak={int(np.abs(pcm.astype(np.int32)).max(initial=0))};zc={int((sign[1:] != sign[:-1]).sum())};alaw={_rms(ALAW_PCM[np.frombuffer(samples, np.uint8)]):.3f};pcm{rate}={zlib.crc32(out)}"
    return [len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature, None, wave(out, PCM, rate, 2, 16) if keep_pcm else None, raw]


def _adpcm_levels(rows: list[list]) -> None:
    """Adds to each feature the RMS of its samples read as ADPCM blocks, all rows' blocks at once."""
    held = [(r, np.frombuffer(r[8], np.uint8)) for r in rows if r[8] is not None]
    held = [(r, x[: len(x) // PAD * PAD].reshape(-1, PAD)) for r, x in held]
    blocks = np.concatenate([x for _, x in held] or [np.zeros((0, PAD), np.uint8)])
    power = np.empty(len(blocks), np.int64)
    for lo in range(0, len(blocks), 1 << 14):
        wide = adpcm_blocks(blocks[lo : lo + (1 << 14)]).astype(np.int64)
        power[lo : lo + (1 << 14)] = np.einsum("ij,ij->i", wide, wide)
    at = 0
    for r, x in held:
        total = int(power[at : at + len(x)].sum())
        at += len(x)
        r[5] += f";adpcm={np.sqrt(total / max(1, len(x) * (2 * PAD - 7))):.3f}"
