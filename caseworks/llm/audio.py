"""Telephony audio columns: WAV with mu-law, A-law or IMA ADPCM samples, expanded to 16-bit PCM and resampled.

The companded codecs expand by 256-entry lookup tables made from their formulas; ADPCM decodes block by block with
numpy, one step for the same nibble of all blocks of a batch at once. Resampling doubles the rate by a fixed symmetric
half-band filter.

Defined results: null text is an empty payload of 64 zero bytes; equal texts give equal media; an ADPCM header's step
index beyond the table counts as the table's last; extra columns are ignored; any length of text is processed whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from caseworks.llm.common import materialize, table

BLOCK = 64
RATE = 8000
# WAVE format tags.
MULAW, ALAW, ADPCM = 7, 6, 17
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "ima-adpcm"}
#: Samples of an ADPCM block: one in its header, two in each further byte.
BLOCK_SAMPLES = (BLOCK - 4) * 2 + 1
#: ADPCM blocks decoded at once.
BLOCKS_AT_ONCE = 16384

# IMA ADPCM index changes by nibble.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
# IMA ADPCM step sizes.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
# Half-band filter taps of the interpolated samples, in 1/256.
TAPS = (-3, 17, -45, 159, 159, -45, 17, -3)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    value = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 0x80, -value, value).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, low = (code >> 4) & 7, ((code & 15) << 4) + 8
    value = np.where(part == 0, low, (low + 256) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, value, -value).astype(np.int16)


LOOKUP = {MULAW: mulaw_table(), ALAW: alaw_table()}


def decode_adpcm(data: np.ndarray) -> np.ndarray:
    """PCM (blocks x BLOCK_SAMPLES) of ADPCM blocks (blocks x BLOCK bytes)."""
    out = np.empty((BLOCK_SAMPLES, len(data)), np.int16)
    value = data[:, 0].astype(np.int32) | (data[:, 1].astype(np.int32) << 8)
    value -= (value & 0x8000) << 1
    index = np.minimum(data[:, 2].astype(np.int32), len(STEPS) - 1)
    out[0] = value
    for i in range(BLOCK_SAMPLES - 1):
        byte = data[:, 4 + i // 2]
        nibble = (byte >> 4 if i % 2 else byte & 15).astype(np.int32)
        step = STEPS[index]
        change = step >> 3
        change += np.where(nibble & 4, step, 0)
        change += np.where(nibble & 2, step >> 1, 0)
        change += np.where(nibble & 1, step >> 2, 0)
        value = np.clip(value + np.where(nibble & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[nibble], 0, len(STEPS) - 1)
        out[i + 1] = value
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: the samples themselves, and filtered ones between them; edges repeat the end samples."""
    n, half = len(pcm), len(TAPS) // 2
    wide = np.pad(pcm.astype(np.int32), (half - 1, half), mode="edge")
    between = np.full(n, 128, np.int32)
    for i, t in enumerate(TAPS):
        between += t * wide[i : i + n]
    out = np.empty(2 * n, np.int16)
    out[0::2] = pcm
    out[1::2] = np.clip(between >> 8, -32768, 32767)
    return out


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and these with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(BLOCK - len(raw) % BLOCK if len(raw) % BLOCK or not raw else 0)


def wav(payload: bytes, codec: int) -> bytes:
    if codec == ADPCM:
        form = struct.pack("<HHIIHHHH", codec, 1, RATE, RATE * BLOCK // BLOCK_SAMPLES, BLOCK, 4, 2, BLOCK_SAMPLES)
        samples = len(payload) // BLOCK * BLOCK_SAMPLES
    else:
        form = struct.pack("<HHIIHHH", codec, 1, RATE, RATE, 1, 8, 0)
        samples = len(payload)
    chunks = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(chunks)) + chunks


def parse_wav(media: bytes) -> tuple[int, memoryview]:
    """Format tag and the data chunk."""
    view = memoryview(media)
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV")
    pos, codec = 12, None
    while pos + 8 <= len(media):
        kind, size = media[pos : pos + 4], struct.unpack_from("<I", media, pos + 4)[0]
        if kind == b"fmt ":
            codec = struct.unpack_from("<H", media, pos + 8)[0]
        elif kind == b"data":
            return codec, view[pos + 8 : pos + 8 + size]
        pos += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode_pcm(media: list[bytes]) -> list[np.ndarray]:
    """8 kHz PCM of WAVs; the ADPCM blocks of all of them are decoded together, so many at once."""
    parsed = [parse_wav(m) for m in media]
    out: list[np.ndarray | None] = [None] * len(media)
    which = [i for i, (codec, _) in enumerate(parsed) if codec == ADPCM]
    for i, (codec, data) in enumerate(parsed):
        if codec in LOOKUP:
            out[i] = LOOKUP[codec][np.frombuffer(data, np.uint8)]
        elif codec != ADPCM:
            raise ValueError(f"codec {codec}")
    if which:
        blocks = np.frombuffer(b"".join(parsed[i][1] for i in which), np.uint8).reshape(-1, BLOCK)
        pcm = np.concatenate([decode_adpcm(blocks[a : a + BLOCKS_AT_ONCE]) for a in range(0, len(blocks), BLOCKS_AT_ONCE)])
        at = 0
        for i in which:
            n = len(parsed[i][1]) // BLOCK
            out[i] = pcm[at : at + n].reshape(-1)
            at += n
    return out


def feature(pcm: np.ndarray) -> str:
    """Samples, peak, root mean square, zero crossings and CRC of resampled PCM."""
    wide = pcm.astype(np.int64)
    rms = float(np.sqrt((wide * wide).mean())) if len(pcm) else 0.0
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"n={len(pcm)};peak={int(np.abs(wide).max(initial=0))};rms={rms:.3f};zero={crossings};crc={zlib.crc32(pcm.tobytes())}"


def encode_media(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The `keep` columns, n_bytes and media. The codec follows from the payload, so equal texts are stored alike."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = [payload_of(t) for t in pdf["text"]]
            media = [wav(p, (MULAW, ALAW, ADPCM)[zlib.crc32(p) % 3]) for _, p in pairs]
            yield pdf[keep].assign(n_bytes=[n for n, _ in pairs], media=media)

    head = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(list(dict.fromkeys([*keep, "text"]))).mapInPandas(encode, f"{head}, n_bytes long, media binary")


def decode_media(media: DataFrame, keep: list[str], keep_pcm: bool = False) -> DataFrame:
    """The `keep` columns with digests of payload and media, the codec, features and (keep_pcm) the 16 kHz PCM."""
    head = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep)
    schema = head + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string" + (", pcm binary" if keep_pcm else "")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 256):
                part = pdf.iloc[a : a + 256]
                stored = [bytes(m) for m in part["media"]]
                rows = []
                for m, pcm in zip(stored, decode_pcm(stored), strict=True):
                    codec, data = parse_wav(m)
                    wide = resample(pcm)
                    row = (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), feature(wide), NAMES[codec])
                    rows.append((*row, wide.tobytes()) if keep_pcm else row)
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", *["pcm"] * keep_pcm]
                yield pd.concat([part[keep].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return media.select([*keep, "media"]).mapInPandas(decode, schema)


def op8_telephony_audio(spark, sf_dir: str) -> DataFrame:
    stored = materialize(encode_media(table(spark, sf_dir, "documents"), ["doc_id"]), "media")
    return decode_media(stored, ["doc_id", "n_bytes"]).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec")
