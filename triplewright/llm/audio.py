"""Telephony audio columns: companded and ADPCM samples to linear and resampled PCM.

mu-law and A-law bytes expand by one 256-entry table lookup each. ADPCM is
sequential inside a block and independent between blocks, so the decoder steps
once per sample position and treats all blocks of a batch in each step.

``audio_digest`` stores the files in a media column, then goes over them slice by slice:
reads them back, describes their payload, and stores them as resampled PCM. A slice's
files go when its PCM is there, so both forms of all rows are never on disk together. What
it says of the PCM comes from the stored column, read once more.

Nulls count as an empty payload; an empty payload is one block of zero bytes.
Repeated rows give repeated, equal results, rows with a null id too. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplewright.llm.batches import byte_steps, map_batches, portable, text_steps
from triplewright.sources.lines import exists
from triplewright.storage import Scratch

#: Bytes of an ADPCM block: 4 of header and 60 that hold two samples each.
BLOCK = 64
RATE, TARGET_RATE = 8000, 16000
MULAW_TAG, ALAW_TAG, ADPCM_TAG = 7, 6, 0x11
#: ADPCM blocks that one numpy step treats.
BLOCKS_PER_STEP = 16384
#: Slices in which stored files become PCM, and how hard the PCM is packed: its samples follow few patterns.
SLICES, PCM_LEVEL = 4, 7
#: Bytes of files that become PCM at once, and bytes of PCM that a writer holds: PCM has four bytes for one of a file.
PCM_STEP, PCM_GROUP = 1_000_000, 16 << 20

# Step sizes and index moves of IMA ADPCM.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
MOVES = [-1, -1, -1, -1, 2, 4, 6, 8]


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    segment, size = code >> 4 & 7, (code & 15) << 4
    size = np.where(segment == 0, size + 8, size + 264 << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """By 16 * index + code: the change of the predictor, and 16 * the next index."""
    index, code = np.divmod(np.arange(len(STEPS) * 16), 16)
    step = np.array(STEPS)[index]
    change = (step >> 3) + (code & 1) * (step >> 2) + (code >> 1 & 1) * (step >> 1) + (code >> 2 & 1) * step
    after = np.clip(index + np.array(MOVES)[code & 7], 0, len(STEPS) - 1) * 16
    return np.where(code & 8, -change, change).astype(np.int32), after.astype(np.int16)


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """(n, 64) bytes to (n, 121) samples, one step for each sample position of all blocks."""
    change, after = adpcm_tables()
    out = np.empty((1 + 2 * (BLOCK - 4), len(blocks)), np.int16)
    level = (blocks[:, 0].astype(np.uint16) | blocks[:, 1].astype(np.uint16) << 8).view(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int16) * 16
    out[0] = level
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    for at in range(2 * (BLOCK - 4)):
        half = columns[at >> 1]
        key = index + (half >> 4 if at & 1 else half & 15)
        level += change.take(key)
        np.clip(level, -32768, 32767, out=level)
        index = after.take(key)
        out[at + 1] = level
    return out.T


def resample(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Linear interpolation in whole numbers; the last sample holds. One slice for each output phase."""
    if not len(samples) or rate == target:
        return samples.copy()
    common = np.gcd(rate, target)
    up, down = target // common, rate // common
    held = np.append(samples, samples[-1:]).astype(np.int32)
    out = np.empty((len(samples) * up + down - 1) // down, np.int16)
    for phase in range(min(up, len(out))):
        first, part = divmod(phase * down, up)
        n = len(range(phase, len(out), up))
        left, right = held[first::down][:n], held[first + 1 :: down][:n]
        out[phase::up] = (left * (up - part) + right * part) // up
    return out


def wav_pack(payload: bytes, tag: int = MULAW_TAG, rate: int = RATE) -> bytes:
    """A RIFF file whose data chunk is the payload, byte for byte."""
    align, bits = (BLOCK, 4) if tag == ADPCM_TAG else (1, 8)
    frames = len(payload) // BLOCK * (2 * BLOCK - 7) if tag == ADPCM_TAG else len(payload)
    speed = rate * BLOCK // (2 * BLOCK - 7) if tag == ADPCM_TAG else rate
    extra = struct.pack("<HH", 2, 2 * BLOCK - 7) if tag == ADPCM_TAG else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", tag, 1, rate, speed, align, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, frames)
    body += b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wav_unpack(media: bytes) -> tuple[int, int, bytes]:
    """(format tag, rate, bytes of the data chunk)."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            return tag, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\0" * (-len(data) % BLOCK if data else BLOCK)


def pcm_of(media: bytes, target: int = TARGET_RATE) -> tuple[int, bytes]:
    """(rate, little-endian 16-bit PCM) of a stored file, resampled to ``target``."""
    tag, rate, data = wav_unpack(media)
    codes = np.frombuffer(data, np.uint8)
    if tag == ADPCM_TAG:
        linear = adpcm_decode(codes[: len(codes) // BLOCK * BLOCK].reshape(-1, BLOCK)).reshape(-1)
    else:
        linear = {MULAW_TAG: mulaw_table, ALAW_TAG: alaw_table}[tag]()[codes]
    return target, resample(linear, rate, target).astype("<i2").tobytes()


def store_audio(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: int = MULAW_TAG) -> DataFrame:
    """doc_id, n_bytes, media (the stored file): each text's UTF-8 bytes, how many, and padded as telephony samples. Null or empty text: 64 zero bytes."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_steps(batches):
            lengths, payloads = zip(*map(padded, texts), strict=True)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(lengths, pa.int64()), pa.array([wav_pack(x, tag) for x in payloads], pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), kernel, "doc_id long, n_bytes long, media binary")


def decode_audio(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", target: int = TARGET_RATE) -> DataFrame:
    """id, rate, pcm: stored files as resampled 16-bit PCM. Null or unreadable media gives null rate and pcm."""

    def decoded(media: bytes | None) -> tuple[int | None, bytes | None]:
        try:
            return pcm_of(media or b"", target)
        except (ValueError, KeyError, struct.error):
            return None, None

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_steps(batches, "media", PCM_STEP):
            rates, pcms = zip(*map(decoded, batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rates, pa.int32()), pa.array(pcms, pa.binary())], ["doc_id", "rate", "pcm"])

    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).cast("binary").alias("media")), kernel, "doc_id long, rate int, pcm binary")


def features(datas: list[bytes]) -> tuple[list[str], list[bytes]]:
    """Whole-number features of read-back payloads (both companding laws, ADPCM blocks), and the payloads' resampled PCM."""
    codes = np.frombuffer(b"".join(datas), np.uint8)
    sizes = np.array([len(x) for x in datas])
    starts = np.cumsum(sizes) - sizes
    mu, law = mulaw_table()[codes], alaw_table()[codes]
    power = [np.add.reduceat(np.square(x, dtype=np.int64), starts) for x in (mu, law)]
    peak = np.maximum.reduceat(np.abs(mu.astype(np.int32)), starts)
    turn = np.zeros(len(mu), np.int64)
    turn[1:] = (mu[1:] < 0) != (mu[:-1] < 0)
    turn[starts] = 0
    turns = np.add.reduceat(turn, starts)
    blocks = codes.reshape(-1, BLOCK)
    decoded = np.concatenate([adpcm_decode(blocks[at : at + BLOCKS_PER_STEP]) for at in range(0, len(blocks), BLOCKS_PER_STEP)])
    out, pcms = [], []
    for k, (start, size) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
        pcms.append(resample(mu[start : start + size], RATE, TARGET_RATE).astype("<i2").tobytes())
        adpcm = decoded[start // BLOCK : (start + size) // BLOCK]
        out.append(
            f"mulaw:{peak[k]}:{power[0][k]}:{turns[k]};alaw:{power[1][k]};"
            f"adpcm:{adpcm.size}:{zlib.crc32(np.ascontiguousarray(adpcm).data):08x}"
        )
    return out, pcms


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def to_pcm(stored: DataFrame) -> DataFrame:
    """What ``DIGEST`` says of stored mu-law files (doc_id, n_bytes, media), and pcm: the files as resampled 16-bit PCM."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_steps(batches, "media", PCM_STEP):
            if not batch.num_rows:
                continue
            medias = batch.column(2).to_pylist()
            back = [wav_unpack(m)[2] for m in medias]
            said, pcms = features(back)
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([len(x) for x in back], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                pa.array([zlib.crc32(x[-BLOCK:]) for x in back], pa.int64()),
                pa.array([len(x) for x in medias], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in medias]),
                pa.array(said),
                pa.array(pcms, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*[c.split()[0] for c in DIGEST.split(", ")], "pcm"])

    return map_batches(stored.select("doc_id", "n_bytes", "media"), kernel, f"{DIGEST}, pcm binary")


def described(stored: DataFrame) -> DataFrame:
    """``DIGEST`` of a stored PCM column: its samples are counted and summed up from what was stored."""
    said = F.format_string(f";pcm{TARGET_RATE}:%d:%s", (F.octet_length("pcm") / 2).cast("long"), F.lpad(F.lower(F.hex(F.crc32("pcm"))), 8, "0"))
    return stored.withColumn("feature", F.concat("feature", said)).drop("pcm")


def audio_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every text as a mu-law file into a media column in the shared folder, read the files back, store them as resampled PCM, and describe what came back.

    One row for each input row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. A null text is an empty one.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "audio")
    media, kind = f"{scratch.root}/media", "doc_id long, n_bytes long, media binary"
    stored = store_audio(df, id_col, text_col).withColumn("slice", F.pmod(F.xxhash64("doc_id", "n_bytes"), F.lit(SLICES)).cast("int"))
    stored.write.partitionBy("slice").options(compression="zstd").parquet(media)
    paths = []
    for k in range(SLICES):
        one = f"{media}/slice={k}"
        if exists(spark, one):
            paths.append(scratch.put(to_pcm(spark.read.schema(kind).parquet(one)), "pcm", **{"compression": "zstd", "parquet.compression.codec.zstd.level": str(PCM_LEVEL), "parquet.block.size": str(PCM_GROUP)}))
            scratch.drop(one)
    if not paths:
        return spark.createDataFrame([], DIGEST)
    return described(spark.read.schema(f"{DIGEST}, pcm binary").parquet(*paths))


portable(__name__)
