import glob
import hashlib
import struct
import zlib

import numpy as np

from tests.llm import brute
from triplewright.llm import audio
from triplewright.storage import Scratch


def slow_adpcm(block):
    level = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [level]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = audio.STEPS[index]
            move = step >> 3
            move += (step >> 2) if code & 1 else 0
            move += (step >> 1) if code & 2 else 0
            move += step if code & 4 else 0
            level = max(-32768, min(32767, level - move if code & 8 else level + move))
            index = max(0, min(88, index + audio.MOVES[code & 7]))
            out.append(level)
    return out


def test_adpcm_equals_a_block_at_a_time():
    blocks = np.random.default_rng(1).integers(0, 256, (50, 64), dtype=np.uint8)
    assert audio.adpcm_decode(blocks).tolist() == [slow_adpcm(b.tobytes()) for b in blocks]


def test_companding_tables():
    mu, law = audio.mulaw_table(), audio.alaw_table()
    assert (mu[0], mu[0x7F], mu[0x80], mu[0xFF]) == (-32124, 0, 32124, 0)
    assert (law[0xD5], law[0x55], law[0xAA], law[0x2A]) == (8, -8, 32256, -32256)
    assert sorted(mu[:128].tolist()) == sorted((-mu[128:]).tolist()) and len(set(law.tolist())) == 256


def test_resampling():
    assert audio.resample(np.array([0, 10, 20], np.int16), 8000, 16000).tolist() == [0, 5, 10, 15, 20, 20]
    assert audio.resample(np.arange(8, dtype=np.int16), 16000, 8000).tolist() == [0, 2, 4, 6]
    assert audio.resample(np.array([3], np.int16), 8000, 11025).tolist() == [3, 3]


def test_digest(spark):
    df = spark.createDataFrame(list(enumerate(brute.EDGE + [brute.EDGE[5]])), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in audio.audio_digest(df).collect()}
    for i, text in enumerate(brute.EDGE):
        data = (text or "").encode()
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
    assert {k: v for k, v in rows[len(brute.EDGE)].asDict().items() if k != "doc_id"} == {k: v for k, v in rows[5].asDict().items() if k != "doc_id"}


def plain_feature(data):
    """The feature string of a payload, one sample at a time."""

    def mulaw(b):
        b = ~b & 255
        size = (((b & 15) * 8 + 132) << (b >> 4 & 7)) - 132
        return -size if b & 128 else size

    def alaw(b):
        b ^= 0x55
        low, segment = (b & 15) * 16, b >> 4 & 7
        size = low + 8 if segment == 0 else (low + 264) << (segment - 1)
        return size if b & 128 else -size

    mu, law = [mulaw(b) for b in data], [alaw(b) for b in data]
    turns = sum((a < 0) != (b < 0) for a, b in zip(mu, mu[1:]))
    adpcm = [x for at in range(0, len(data), 64) for x in slow_adpcm(data[at : at + 64])]
    pcm = [y for a, b in zip(mu, mu[1:] + mu[-1:]) for y in (a, (a + b) // 2)]
    crc = [zlib.crc32(struct.pack(f"<{len(x)}h", *x)) for x in (adpcm, pcm)]
    return f"mulaw:{max(map(abs, mu))}:{sum(x * x for x in mu)}:{turns};alaw:{sum(x * x for x in law)};adpcm:{len(adpcm)}:{crc[0]:08x};pcm16000:{len(pcm)}:{crc[1]:08x}"


def test_features_and_stored_form_equal_a_plain_version(spark):
    texts = [t for t in brute.EDGE if len(t or "") < 3000] + ["tail " * 700, "ü" * 64]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, media string, n_bytes int")
    for r in audio.audio_digest(df).collect():
        data = (texts[r["doc_id"]] or "").encode()
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        head = b"WAVEfmt " + bytes.fromhex("12000000 0700 0100 401f0000 401f0000 0100 0800 0000") + b"fact" + struct.pack("<II", 4, len(payload))
        media = b"RIFF" + struct.pack("<I", len(head) + 8 + len(payload)) + head + b"data" + struct.pack("<I", len(payload)) + payload
        assert r["media_bytes"] == len(media) and r["media_sha256"] == hashlib.sha256(media).hexdigest()
        assert r["feature"] == plain_feature(payload)


def test_empty_table_and_very_long_text(spark):
    df = spark.createDataFrame([(1, "long ü " * 600_000), (2, "short")], "doc_id long, text string")
    assert audio.audio_digest(df.limit(0)).count() == 0
    rows = {r["doc_id"]: r for r in audio.audio_digest(df).collect()}
    data = ("long ü " * 600_000).encode()
    assert rows[1]["payload_sha256"] == hashlib.sha256(data + b"\0" * (-len(data) % 64)).hexdigest()


def test_stored_files_decode(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    for tag in (audio.MULAW_TAG, audio.ALAW_TAG, audio.ADPCM_TAG):
        rows = audio.decode_audio(audio.store_audio(df, tag=tag)).collect()
        assert {r["rate"] for r in rows} == {16000} and all(len(r["pcm"]) in (256, 484) for r in rows)
    bad = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "doc_id long, media binary")
    assert [r["pcm"] for r in audio.decode_audio(bad).collect()] == [None, None]


def test_pcm_is_stored_and_read_back(spark, monkeypatch):
    """What is in the shared folder afterwards: PCM of every row, and no media file; rows with null ids are rows."""
    kept = []
    monkeypatch.setattr(audio, "Scratch", lambda *a: kept.append(Scratch(*a)) or kept[-1])
    texts = [t for t in brute.EDGE if len(t or "") < 3000]
    rows = [(None if i % 5 == 0 else i, t) for i, t in enumerate(texts)]
    out = audio.audio_digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    root = kept[0].root.removeprefix("file://")
    assert glob.glob(f"{root}/*-pcm") and not glob.glob(f"{root}/media/slice=*")
    stored = spark.read.parquet(*glob.glob(f"{root}/*-pcm")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in stored) == sorted((i is None, i or 0) for i, _ in rows)
    want = {}
    for i, t in rows:
        payload = (t or "").encode()
        payload += b"\0" * (-len(payload) % 64 if payload else 64)
        mu = audio.mulaw_table()[np.frombuffer(payload, np.uint8)].tolist()
        want.setdefault((i, hashlib.sha256(payload).hexdigest()), struct.pack(f"<{2 * len(mu)}h", *[y for a, b in zip(mu, mu[1:] + mu[-1:]) for y in (a, (a + b) // 2)]))
    assert {(r["doc_id"], r["payload_sha256"]): bytes(r["pcm"]) for r in stored} == want
    said = sorted(r["feature"].split("pcm16000:")[1] for r in out.collect())
    assert said == sorted(f"{len(r['pcm']) // 2}:{zlib.crc32(r['pcm']):08x}" for r in stored)
