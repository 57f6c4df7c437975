"""Media columns: telephony audio. mu-law and A-law by lookup tables, IMA ADPCM by numpy across blocks, resampled PCM.

A text is stored as a companded WAVE file, whose codes are its bytes. Beside it a row can hold an IMA ADPCM file of the same sound, and
resampled PCM decoded from that file; all blocks of a slice of rows are coded or decoded together, a step of the format at a time.

Behaviour: a null text is empty; an empty payload is one block of 192 spaces; every byte string is a legal stream of
8-bit companded samples, so storage is lossless for any text (as ADPCM it is lossy: only the number of samples is kept); null media and
media that can't be read - no WAVE file, another format, no rate, channels or blocks - give nulls; channels are averaged; a last ADPCM
block that is cut short gives the samples it has; repeated rows give repeated results; extra columns are dropped by ``to_audio`` and
``digest`` and kept by ``store_pcm``, where ``pcm`` and ``pcm_rate`` are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import give_back, slices, spread, table, text_buffers, text_slices

RATE, PCM_RATE = 8000, 16000
BLOCK = 192
PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
#: Samples of an ADPCM block that is written.
IMA_SAMPLES = 505


def mulaw_table() -> np.ndarray:
    """G.711 mu-law code to 16-bit PCM."""
    u = ~np.arange(256) & 0xFF
    mag = (((u & 0x0F) << 3) + 0x84 << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -mag, mag).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law code to 16-bit PCM."""
    a = np.arange(256) ^ 0x55
    exp, mant = (a & 0x70) >> 4, (a & 0x0F) << 4
    mag = np.where(exp == 0, mant + 8, (mant + 0x108) << np.maximum(exp - 1, 0))
    return np.where(a & 0x80, mag, -mag).astype(np.int16)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()
#: Fixed values of the IMA ADPCM format: step sizes and index changes.
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def ima_decode(blocks: np.ndarray, channels: int = 1) -> np.ndarray:
    """IMA ADPCM blocks (rows of bytes) to PCM [block, sample, channel], all blocks a step at a time.

    A block has a head per channel (int16 predictor, index, reserved), then nibbles, low ones first, four bytes a channel in turn."""
    n = len(blocks)
    head = blocks[:, : 4 * channels].reshape(n * channels, 4)
    data = blocks[:, 4 * channels :].reshape(n, -1, channels, 4).transpose(0, 2, 1, 3).reshape(n * channels, -1)
    predictor = head[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(head[:, 2].astype(np.int32), 0, 88)
    out = np.empty((1 + 2 * data.shape[1], n * channels), np.int16)
    out[0] = predictor
    columns = np.ascontiguousarray(data.T).astype(np.int32)
    for k in range(2 * data.shape[1]):
        nib = columns[k >> 1] >> (4 * (k & 1)) & 15
        step = IMA_STEPS[index]
        diff = (step >> 3) + (step >> 2) * (nib & 1) + (step >> 1) * (nib >> 1 & 1) + step * (nib >> 2 & 1)
        predictor = np.clip(predictor + np.where(nib & 8, -diff, diff), -32768, 32767)
        index = np.clip(index + IMA_MOVES[nib], 0, 88)
        out[k + 1] = predictor
    return out.reshape(-1, n, channels).transpose(1, 0, 2)


def ima_encode(pcm: np.ndarray, samples: int = IMA_SAMPLES) -> np.ndarray:
    """PCM rows of ``samples`` values (odd) to mono IMA ADPCM blocks, all blocks a step at a time."""
    pcm = np.ascontiguousarray(pcm.reshape(-1, samples).T).astype(np.int32)
    blocks = np.zeros((pcm.shape[1], 4 + samples // 2), np.uint8)
    predictor, index = pcm[0].copy(), np.zeros(pcm.shape[1], np.int32)
    blocks[:, :2] = predictor.astype("<i2").view(np.uint8).reshape(-1, 2)
    for k in range(samples - 1):
        step, delta = IMA_STEPS[index], pcm[k + 1] - predictor
        nib, left, diff = np.where(delta < 0, 8, 0), np.abs(delta), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            hit = left >= part
            nib, left, diff = nib | bit * hit, left - part * hit, diff + part * hit
        predictor = np.clip(predictor + np.where(nib & 8, -diff, diff), -32768, 32767)
        index = np.clip(index + IMA_MOVES[nib], 0, 88)
        blocks[:, 4 + (k >> 1)] |= (nib << (4 * (k & 1))).astype(np.uint8)
    return blocks


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear-interpolation resampling to int16 PCM; beyond the last sample its value."""
    if rate == to or not len(pcm):
        return pcm.astype(np.int16)
    at = np.arange(max(1, len(pcm) * to // rate), dtype=np.int64) * rate
    left, part = at // to, (at % to) / to
    x = pcm.astype(np.float64)
    return np.rint(x[left] + part * (x[np.minimum(left + 1, len(x) - 1)] - x[left])).astype(np.int16)


@dataclass(frozen=True)
class Wave:
    """What a WAVE file holds; ``samples`` per channel, where the file says so."""

    kind: int
    channels: int
    rate: int
    align: int
    data: bytes
    samples: int | None = None


def wav(payload: bytes, kind: int = MULAW, rate: int = RATE, align: int = 1, samples: int | None = None) -> bytes:
    """A RIFF/WAVE file with one channel; ADPCM files have the samples of a block in their format and all ``samples`` in a fact chunk."""
    bits, per_block = 4 if kind == IMA else 16 if kind == PCM else 8, max(1, 2 * (align - 4) + 1)
    second = rate * align // per_block if kind == IMA else rate * align
    fmt = struct.pack("<HHIIHH", kind, 1, rate, second, align, bits) + {PCM: b"", IMA: struct.pack("<HH", 2, per_block)}.get(kind, b"\0\0")
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt
    if kind == IMA:
        body += b"fact" + struct.pack("<II", 4, len(payload) // max(align, 1) * per_block if samples is None else samples)
    body += b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> Wave:
    """The parts of a RIFF/WAVE file; chunks of other kinds are skipped. ValueError for anything that can't be played."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, fmt, samples = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            if size < 16 or at + 24 > len(media):
                raise ValueError("format chunk too short")
            fmt = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"fact" and size >= 4 and at + 12 <= len(media):
            samples = struct.unpack_from("<I", media, at + 8)[0]
        elif name == b"data":
            if fmt is None:
                raise ValueError("data before the format")
            kind, channels, rate, _, align, _ = fmt
            least = {PCM: 2 * channels, MULAW: channels, ALAW: channels, IMA: 4 * channels + 1}.get(kind)
            if least is None or not rate or not channels or align < least or (kind == IMA and align % (4 * channels)):
                raise ValueError(f"format {kind}, {channels} channels, rate {rate}, block of {align}")
            return Wave(kind, channels, rate, align, media[at + 8 : at + 8 + size], samples)
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def parsed(files: list[bytes | None]) -> list[Wave | None]:
    """Files as read; None for null and for what can't be read."""
    out = []
    for f in files:
        try:
            out.append(None if f is None else read_wav(f))
        except ValueError:
            out.append(None)
    return out


def pcm_of(waves: list[Wave | None]) -> list[np.ndarray | None]:
    """One channel of PCM of each file. The ADPCM blocks of all files of one shape are decoded together."""
    out: list[np.ndarray | None] = [None] * len(waves)
    adpcm: dict[tuple[int, int], list[int]] = {}
    for i, w in enumerate(waves):
        if w is None:
            continue
        codes = np.frombuffer(w.data, np.uint8)
        if w.kind == IMA:
            adpcm.setdefault((w.align, w.channels), []).append(i)
            continue
        if w.kind == PCM:
            x = codes[: len(codes) // 2 * 2].view("<i2")
        else:
            x = (MULAW_PCM if w.kind == MULAW else ALAW_PCM)[codes]
        out[i] = x if w.channels == 1 else np.rint(x[: len(x) // w.channels * w.channels].reshape(-1, w.channels).mean(1)).astype(np.int16)
    for (align, channels), rows in adpcm.items():
        padded = [w.data + b"\0" * (-len(w.data) % align) for w in (waves[i] for i in rows)]
        pcm = ima_decode(np.frombuffer(b"".join(padded), np.uint8).reshape(-1, align), channels)
        pcm = pcm[:, :, 0] if channels == 1 else np.rint(pcm.mean(2)).astype(np.int16)
        at = 0
        for i, p in zip(rows, padded, strict=True):
            n, rest = len(p) // align, len(waves[i].data) % align
            x = pcm[at : at + n].reshape(-1)
            if rest:  # the block that was cut
                whole = 4 * channels
                x = x[: (n - 1) * pcm.shape[1] + (1 + 2 * ((rest - whole) // whole * 4) if rest >= whole else 0)]
            out[i] = x[: waves[i].samples] if waves[i].samples is not None else x
            at += n
    return out


def ima_files(pcms: list[np.ndarray], rate: int = RATE) -> list[bytes]:
    """An ADPCM file of each sound; all of their blocks are coded together. The last block is filled with the last sample."""
    padded = [np.concatenate([x, np.repeat(x[-1:], -len(x) % IMA_SAMPLES)]) for x in pcms]
    blocks = ima_encode(np.concatenate(padded)) if padded else np.zeros((0, 4 + IMA_SAMPLES // 2), np.uint8)
    at, out = 0, []
    for x, p in zip(pcms, padded, strict=True):
        n = len(p) // IMA_SAMPLES
        out.append(wav(blocks[at : at + n].tobytes(), IMA, rate, blocks.shape[1], len(x)))
        at += n
    return out


def decode(media: bytes) -> tuple[np.ndarray, int]:
    """PCM (one channel) and rate of a mu-law, A-law, IMA ADPCM or PCM file."""
    w = read_wav(media)
    return pcm_of([w])[0], w.rate


def store_pcm(df: DataFrame, column: str = "media", to: int = PCM_RATE) -> DataFrame:
    """Adds ``pcm`` (little-endian int16 at ``to`` Hz) and ``pcm_rate``; both are null for null media and media that can't be read."""

    def run(batches):
        for b in batches:
            keep = [i for i, n in enumerate(b.schema.names) if n not in ("pcm", "pcm_rate")]
            media = b.column(b.schema.get_field_index(column))
            for lo, hi in slices(text_buffers(media)[1]):
                waves = parsed(media.slice(lo, hi - lo).to_pylist())
                out = [None if x is None else resample(x, w.rate, to).astype("<i2").tobytes() for x, w in zip(pcm_of(waves), waves, strict=True)]
                rates = pa.array([None if x is None else to for x in out], pa.int32())
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in keep), pa.array(out, pa.binary()), rates], names=[*(b.schema.names[i] for i in keep), "pcm", "pcm_rate"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in ("pcm", "pcm_rate"))
    return df.mapInArrow(run, f"{fields}, pcm binary, pcm_rate int")


def features(pcm: np.ndarray) -> str:
    """RMS, peak, zero-crossing rate and mean of samples, fixed precision."""
    x = pcm.astype(np.int64)
    rms = float(np.sqrt(np.dot(x, x) / len(x)))
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"rms={rms:.3f};peak={int(np.abs(x).max())};zcr={crossings / len(x):.6f};mean={x.mean():.3f};n={len(x)}"


def to_audio(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: int = MULAW, derived: bool = False) -> DataFrame:
    """Stores each text as a telephony WAVE file of ``kind``: (id, n_bytes, media). The bytes are the codes of mu-law or A-law; for ADPCM
    they are played as mu-law and coded anew.

    With ``derived`` also ``adpcm``, an ADPCM file of the sound that the media hold, and ``pcm``, what that file gives at ``PCM_RATE``."""
    if kind not in (MULAW, ALAW, IMA):
        raise ValueError(f"format {kind}")

    def run(batches):
        for b in batches:
            for lo, hi, data, off in text_slices(b.column(1)):
                raw = data.tobytes()
                texts = [raw[p:q] for p, q in zip(off[:-1], off[1:], strict=True)]
                payloads = [t + b" " * ((-len(t)) % BLOCK or BLOCK * (not t)) for t in texts]
                media = ima_files([MULAW_PCM[np.frombuffer(p, np.uint8)] for p in payloads]) if kind == IMA else [wav(p, kind) for p in payloads]
                cols = [pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())]
                if derived:
                    adpcm = ima_files(pcm_of(parsed(media)))
                    pcm = [resample(x, RATE, PCM_RATE).astype("<i2").tobytes() for x in pcm_of(parsed(adpcm))]
                    cols += [pa.array(adpcm, pa.binary()), pa.array(pcm, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *cols], names=[id_col, "n_bytes", "media", *(("adpcm", "pcm") if derived else ())])
        give_back()

    more = ", adpcm binary, pcm binary" if derived else ""
    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes long, media binary{more}")


def digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads stored files back: payload and media digests and features, and digests of ``adpcm`` and ``pcm`` where the table has them.
    All but the id and n_bytes are null for media that can't be read."""
    derived = [c for c in ("adpcm", "pcm") if c in df.columns]

    def sha(x: bytes | None) -> str | None:
        return None if x is None else hashlib.sha256(x).hexdigest()

    def run(batches):
        for b in batches:
            for lo, hi in slices(text_buffers(b.column(2))[1]):
                media = b.column(2).slice(lo, hi - lo).to_pylist()
                waves = parsed(media)
                sounds = pcm_of(waves)
                rows = [
                    (len(w.data), sha(w.data), zlib.crc32(w.data[-16:]), len(m), sha(m), features(x) if len(x) else "n=0") if w else (None,) * 6
                    for w, m, x in zip(waves, media, sounds, strict=True)
                ]
                for k in range(len(derived)):
                    more = b.column(3 + k).slice(lo, hi - lo).to_pylist()
                    rows = [(*r, None if x is None else len(x), sha(x)) for r, x in zip(rows, more, strict=True)]
                cols = [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), *cols], names=[id_col, "n_bytes", *(n for n, _ in fields)])
        give_back()

    fields = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    for c in derived:
        fields += [(f"{c}_bytes", pa.int64()), (f"{c}_sha256", pa.string())]
    schema = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in fields)
    return df.select(id_col, "n_bytes", "media", *derived).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes long, {schema}")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(to_audio(table(spark, sf_dir, "documents"), derived=True))
