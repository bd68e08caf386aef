"""Telephony audio columns: 8-bit mu-law or A-law samples, ADPCM blocks, resampled PCM.

Stored audio is a WAV file in memory, of a codec that a hash of the payload chooses (or the caller). Reading it back parses the
container, expands companded samples by a lookup table (or decodes the blocks of a file step by step for all blocks at
once), and resamples the PCM, which is stored as a column.

* null text is empty (one padding unit); repeated rows and equal texts get equal values; a null doc_id is kept;
  extra columns are ignored; an empty table gives no rows.
* very long texts are one file each; a task holds a few megabytes of texts and their media, and at least one row, at a time.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starweave.llm.common import table

UNIT = 192
# Format tags of the container.
TAGS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 17}
RATE = 8000


def mulaw_table() -> np.ndarray:
    """PCM of each mu-law code, from its rule: complemented code, sign, 3 bits of exponent, 4 of mantissa, bias 132."""
    code = ~np.arange(256, dtype=np.int32) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of each A-law code, from its rule: even bits inverted, segment 0 linear."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, mantissa = code >> 4 & 7, code & 15
    size = np.where(segment == 0, (mantissa << 4) + 8, (mantissa << 4) + 264 << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


EXPAND = {"mulaw": mulaw_table(), "alaw": alaw_table()}
# The ADPCM step sizes.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
        7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    dtype=np.int32,
)
# Index changes for the three low bits of an ADPCM code.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def store(payload: bytes, codec: str = "mulaw", block: int = 256, rate: int = RATE) -> bytes:
    """A mono WAV file whose data chunk is the payload, as samples (or ADPCM blocks) of the codec."""
    bits, align = (4, block) if codec == "ima_adpcm" else (8, 1)
    per_block = (block - 4) * 2 + 1 if codec == "ima_adpcm" else 1
    extra = struct.pack("<HH", 2, per_block) if codec == "ima_adpcm" else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", TAGS[codec], 1, rate, rate * align // per_block, align, bits) + extra
    pad = b"\0" * (len(payload) % 2)
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def load(media: bytes) -> tuple[str, int, int, bytes]:
    """Codec, rate, block size and data of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, data = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", media[at + 8 : at + 24])
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or data is None:
        raise ValueError("the WAV file lacks a chunk")
    return {v: k for k, v in TAGS.items()}[form[0]], form[2], form[4], data


def decode_adpcm(data: bytes, block: int) -> np.ndarray:
    """PCM of whole IMA ADPCM blocks: one step of all blocks at a time. A shorter last block is dropped by contract."""
    n = len(data) // block
    if not n:
        return np.zeros(0, dtype=np.int16)
    raw = np.frombuffer(data, dtype=np.uint8, count=n * block).reshape(n, block)
    value = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(raw[:, 2].astype(np.int32), 0, 88)
    codes = np.empty((n, (block - 4) * 2), dtype=np.uint8)
    codes[:, 0::2], codes[:, 1::2] = raw[:, 4:] & 15, raw[:, 4:] >> 4
    out = np.empty((n, codes.shape[1] + 1), dtype=np.int16)
    out[:, 0] = value
    for k in range(codes.shape[1]):
        code, step = codes[:, k], STEPS[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code & 7], 0, 88)
        out[:, k + 1] = value
    return out.reshape(-1)


def pcm_of(media: bytes) -> tuple[np.ndarray, int]:
    codec, rate, block, data = load(media)
    if codec == "ima_adpcm":
        return decode_adpcm(data, block), rate
    return EXPAND[codec][np.frombuffer(data, dtype=np.uint8)], rate


def pcm_of_all(files: list[bytes]) -> list[tuple[np.ndarray, int]]:
    """``pcm_of`` of each file; the ADPCM blocks of all files with one block size are decoded side by side."""
    loaded = [load(f) for f in files]
    out = [(np.zeros(0, dtype=np.int16) if codec == "ima_adpcm" else EXPAND[codec][np.frombuffer(data, dtype=np.uint8)], rate) for codec, rate, _, data in loaded]
    for block in {block for codec, _, block, _ in loaded if codec == "ima_adpcm"}:
        own = [i for i, x in enumerate(loaded) if x[0] == "ima_adpcm" and x[2] == block]
        blocks = [len(loaded[i][3]) // block for i in own]
        pcm = decode_adpcm(b"".join(loaded[i][3][: n * block] for i, n in zip(own, blocks, strict=True)), block)
        for i, part in zip(own, np.split(pcm, np.cumsum(blocks)[:-1] * ((block - 4) * 2 + 1)), strict=True):
            out[i] = part, loaded[i][1]
    return out


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear resampling in whole numbers: equal inputs give equal outputs on any machine."""
    if rate == to or not len(pcm):
        return pcm
    if to == 2 * rate:
        out = np.empty(2 * len(pcm), dtype=np.int16)
        out[0::2] = pcm
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        out[-1] = pcm[-1]
        return out
    n = len(pcm) * to // rate
    place = np.arange(n, dtype=np.int64) * rate
    left, part = place // to, place % to
    right = np.minimum(left + 1, len(pcm) - 1)
    return ((pcm[left].astype(np.int64) * (to - part) + pcm[right].astype(np.int64) * part) // to).astype(np.int16)


def features(pcm: np.ndarray) -> str:
    """Samples, RMS, peak and sign changes of PCM, as text."""
    if not len(pcm):
        return "n=0;rms=0;peak=0;crossings=0"
    wide = pcm.astype(np.int64)
    power = int(np.dot(wide, wide))  # exact: whole numbers
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"n={len(pcm)};rms={math.isqrt(power // len(pcm))};peak={int(np.abs(wide).max())};crossings={crossings}"


def codec_of(payload: bytes) -> str:
    """The codec of a payload: one of the three by its checksum, so equal texts have equal media."""
    return sorted(TAGS)[zlib.crc32(payload) % len(TAGS)]


#: Bytes of payload whose rows leave a task together.
BYTES_AT_ONCE = 2_000_000


def media_columns(docs: DataFrame, codec: str | None = None, to_rate: int = 16000) -> DataFrame:
    """Each text as telephony audio: ``doc_id``, the ``codec``, ``media`` (the stored file), ``pcm`` (what it sounds as, resampled,
    little-endian 16-bit), and of what is read back from the file: sizes, digests and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, size, texts = 0, 0, []
            for k, raw in enumerate(batch.column(1)):
                texts.append(raw.as_py())
                size += len(texts[-1])
                if size >= BYTES_AT_ONCE or k + 1 == batch.num_rows:
                    columns = [pa.array(x, t) for x, t in zip(zip(*stored(texts), strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), *columns], names)
                    begin, size, texts = k + 1, 0, []

    def stored(texts: list[bytes]) -> list[tuple]:
        payloads = [t + b" " * ((-len(t)) % UNIT if t else UNIT) for t in texts]
        codecs = [codec or codec_of(p) for p in payloads]
        files = [store(p, own, UNIT) for p, own in zip(payloads, codecs, strict=True)]
        rows = []
        for text, own, media, (sound, rate) in zip(texts, codecs, files, pcm_of_all(files), strict=True):
            back, pcm = load(media)[3], resample(sound, rate, to_rate)
            rows.append((own, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(pcm), media, pcm.astype("<i2").tobytes()))
        return rows

    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())
    schema = "doc_id long, codec string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary, pcm binary"
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("b")).mapInArrow(run, schema)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_columns(table(spark, sf_dir, "documents"))
    digests = [F.octet_length("pcm").cast("long").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256")]
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", *digests)
