import hashlib
import math
import zlib

import numpy as np
import pytest

from starweave.llm import media


def payload(text):
    raw = (text or "").encode()
    return raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))


def adpcm(data, block):
    out = []
    for at in range(0, len(data), block):
        value, index = int.from_bytes(data[at : at + 2], "little", signed=True), min(data[at + 2], 88)
        out.append(value)
        for byte in data[at + 4 : at + block]:
            for code in (byte & 15, byte >> 4):
                step = int(media.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + int(media.INDEX_CHANGE[code & 7])))
                out.append(value)
    return out


def expanded(byte, codec):
    """One sample by the standard's bits."""
    if codec == "mulaw":
        byte ^= 255
        size = (((byte & 15) * 8 + 132) * 2 ** (byte >> 4 & 7)) - 132
        return -size if byte & 128 else size
    byte ^= 0x55
    exponent, mantissa = byte >> 4 & 7, byte & 15
    size = mantissa * 16 + 8 if exponent == 0 else (mantissa * 16 + 264) * 2 ** (exponent - 1)
    return size if byte & 128 else -size


def by_hand(text):
    """Codec, stored file, features and resampled PCM of a text, sample by sample."""
    p = payload(text)
    codec = ("alaw", "ima_adpcm", "mulaw")[zlib.crc32(p) % 3]
    word = lambda x: x.to_bytes(4, "little")
    half = lambda x: x.to_bytes(2, "little")
    if codec == "ima_adpcm":
        pcm = adpcm(p, 192)
        form = half(17) + half(1) + word(8000) + word(8000 * 192 // 377) + half(192) + half(4) + half(2) + half(377)
    else:
        pcm = [expanded(b, codec) for b in p]
        form = half({"alaw": 6, "mulaw": 7}[codec]) + half(1) + word(8000) + word(8000) + half(1) + half(8) + half(0)
    chunks = b"fmt " + word(len(form)) + form + b"data" + word(len(p)) + p
    double = [x for a, b in zip(pcm, [*pcm[1:], pcm[-1]], strict=True) for x in (a, (a + b) >> 1)]
    double[-1] = pcm[-1]
    signs = sum((a < 0) != (b < 0) for a, b in zip(double, double[1:], strict=False))
    feature = f"n={len(double)};rms={math.isqrt(sum(x * x for x in double) // len(double))};peak={max(map(abs, double))};crossings={signs}"
    return codec, b"RIFF" + word(4 + len(chunks)) + b"WAVE" + chunks, feature, b"".join(x.to_bytes(2, "little", signed=True) for x in double)


def test_query(spark, sf, documents):
    rows = {r.doc_id: r for r in media.op5_media_columns(spark, sf).collect()}
    assert len(rows) == len(documents)
    assert {r.codec for r in rows.values()} == set(media.TAGS)
    for k, (d, text) in enumerate(sorted(documents, key=lambda x: len(x[1]))):
        p, r = payload(text), rows[d]
        if k % 10 == 0:  # slow by hand
            codec, stored, feature, pcm = by_hand(text)
            assert (r.codec, r.media_bytes, r.media_sha256, r.feature) == (codec, len(stored), hashlib.sha256(stored).hexdigest(), feature)
            assert (r.pcm_bytes, r.pcm_sha256) == (len(pcm), hashlib.sha256(pcm).hexdigest())
        assert (r.n_bytes, r.payload_bytes) == (len(text.encode()), len(p))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "ima_adpcm", None])
def test_edges(tricky, empty, codec):
    rows = media.media_columns(tricky, codec).collect()
    assert sorted(r.payload_sha256 for r in rows) == sorted(hashlib.sha256(payload(r.text)).hexdigest() for r in tricky.collect())
    for r in rows:
        assert r.media_bytes == len(r.media)
        assert media.load(r.media)[0] == r.codec == (codec or r.codec)
        pcm, rate = media.pcm_of(r.media)
        assert np.array_equal(np.frombuffer(r.pcm, dtype="<i2"), media.resample(pcm, rate, 16000))
    assert media.media_columns(empty).count() == 0


def test_tables_follow_the_standard():
    mu, a = media.EXPAND["mulaw"], media.EXPAND["alaw"]
    assert (mu[0], mu[0x80], mu[0x7F], mu[0xFF]) == (-32124, 32124, 0, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert media.STEPS[0] == 7
    assert len(media.STEPS) == 89


def test_adpcm_follows_a_step_by_step_decoder():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 36 * 7 + 5, dtype=np.uint8).tobytes()
    out = []
    for b in range(7):
        block = data[36 * b : 36 * b + 36]
        value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        out.append(value)
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(media.STEPS[index])
                change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + int(media.INDEX_CHANGE[code & 7])))
                out.append(value)
    assert media.decode_adpcm(data, 36).tolist() == out


@pytest.mark.parametrize("rate", [(8000, 11025), (44100, 8000), (8000, 8000)])
def test_resampling_sample_by_sample(rate):
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 977):
        pcm = rng.integers(-32768, 32768, n).astype(np.int16)
        a, b = rate
        want = []
        for k in range(n * b // a):
            left, part = divmod(k * a, b)
            right = min(left + 1, n - 1)
            want.append((int(pcm[left]) * (b - part) + int(pcm[right]) * part) // b)
        assert media.resample(pcm, a, b).tolist() == (want if a != b else pcm.tolist())
