"""Media columns: content-defined chunking, a store without repeated chunks, and verified reading.

A text's UTF-8 bytes, zero-padded to a positive multiple of 64, are the 8-bit samples of a mono WAV stream. A rolling gear
hash over 32 bytes cuts the samples into chunks, named by their SHA-256. Spark groups the digests alone to find those
that occur more than once. Bits of these, SPARE for each of them up to 2**MOST_BITS (32 MB) in all, go to the tasks that
write; so one in SPARE of the other chunks is a false hit, which does no harm, and past 2**MOST_BITS / SPARE shared chunks more of them
are, up to all: then each chunk moves once on writing and once on reading, in proportion to the input. A chunk outside the filter is unique and stays, compressed, in its stream's row; one inside is written
once, to a table grouped by digest, and the row refers to it. So only shared chunks move on writing, and only
streams that use some on reading, when a join by digest brings them back in order. A stream is checked against the
digest of its payload before features are computed. Equal texts share one stream.

Null counts as the empty text (64 zero bytes). Each input row gives a row; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import forget, releasing, written

UNIT = 64
SMALLEST, MASK_BITS, LARGEST = 1024, 12, 16384
SPARE, LEAST_BITS, MOST_BITS = 16, 16, 28
BLOCK_BITS = 16  # bits of the filter that come from one task
RATE = 8000


def gear() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(27)).astype(np.uint32)


GEAR = gear()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - k]] << k over the last 32 bytes, by doubling the window five times."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        more = h.copy()
        more[shift:] += h[:-shift] << np.uint32(shift)
        h = more
    return h


def cuts(data: np.ndarray, smallest: int = SMALLEST, bits: int = MASK_BITS, largest: int = LARGEST) -> list[int]:
    """Ends of the chunks: after the first hash with its top bits zero that leaves smallest bytes, at largest bytes at the latest."""
    ends, last, n = [], 0, len(data)
    places = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - bits) == 0) + 1 if n > smallest else np.empty(0, np.int64)
    while n - last > smallest:
        k = np.searchsorted(places, last + smallest)
        end = min(int(places[k]) if k < len(places) else n, last + largest, n)
        ends.append(end)
        last = end
    if last < n:
        ends.append(n)
    return ends


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def wav_header(n: int) -> bytes:
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n)


def distinct_texts(batches):
    """(key, text) of each batch's distinct texts."""
    for batch in batches:
        seen = set()
        for key, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            if key not in seen:
                seen.add(key)
                yield key, text


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("key"), text.alias("text"))


def pieces(data: bytes) -> list[bytes]:
    ends = cuts(np.frombuffer(data, np.uint8))
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@dataclass(frozen=True)
class Filter:
    """2**size bits by the leading four bytes of digests."""

    size: int
    words: np.ndarray

    def __contains__(self, digest: bytes) -> bool:
        place = int.from_bytes(digest[:4], "big") >> (32 - self.size)
        return bool(self.words[place // 8] >> (place % 8) & 1)


def filter_size(shared: int) -> int:
    """Bits, as a power of two, that leave SPARE of them for each of the shared digests."""
    return min(max((shared * SPARE - 1).bit_length(), LEAST_BITS), MOST_BITS)


def shared_filter(texts: DataFrame) -> Filter:
    """Bits of every digest that more than one place of the distinct texts has."""

    def run(batches):
        for batch in batches:
            found = [(key, hashlib.sha256(p).digest()) for key, text in distinct_texts([batch]) for p in pieces(payload(text)[0])]
            yield pair_batch(found, ["key", "digest"])

    every = texts.mapInArrow(run, "key binary, digest binary")
    # a text met in two tasks counts twice; its chunks are then stored as shared, once
    twice = every.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.substring("digest", 1, 4).alias("head"))
    twice, path = written(twice, "shared")
    size = filter_size(twice.count())
    place = F.shiftright(F.conv(F.hex("head"), 16, 10).cast("long"), 32 - size)
    at = twice.select(F.shiftright(place, BLOCK_BITS).cast("int").alias("block"), place.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").alias("place")).distinct()

    def block(table):
        out = np.zeros(1 << BLOCK_BITS, np.uint8)
        out[table.column("place").to_numpy()] = 1
        return pa.table({"block": table.column("block")[:1], "bits": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})

    rows = at.groupBy("block").applyInArrow(block, "block int, bits binary").collect()  # at most 2**(MOST_BITS - BLOCK_BITS) rows of 8 KB
    words = np.zeros((1 << size) // 8, np.uint8)
    for r in rows:
        words[r.block << BLOCK_BITS - 3 : (r.block + 1) << BLOCK_BITS - 3] = np.frombuffer(r.bits, np.uint8)
    forget(texts.sparkSession, path)
    return Filter(size, words)


def shared_rows(texts: DataFrame, bits) -> DataFrame:
    """(digest, data) of the chunks in the filter; within a task each digest once."""

    def run(batches):
        packer, seen = zstandard.ZstdCompressor(level=3), set()
        for batch in batches:
            out = []
            for _, text in distinct_texts([batch]):
                for piece in pieces(payload(text)[0]):
                    digest = hashlib.sha256(piece).digest()
                    if digest not in seen and digest in bits.value:
                        seen.add(digest)
                        out.append((digest, packer.compress(piece)))
            if len(seen) > 200_000:
                seen = set()
            yield pair_batch(out, ["digest", "data"])

    return texts.mapInArrow(run, "digest binary, data binary").groupBy("digest").agg(F.first("data").alias("data"))


def pair_batch(rows, names) -> pa.RecordBatch:
    a, b = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=names)


def streams(texts: DataFrame, bits) -> DataFrame:
    """(key, n_bytes, payload_sha, refers, digests, data): each stream's chunks in order, data null where the chunk is shared."""
    names = ["key", "n_bytes", "payload_sha", "refers", "digests", "data"]
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.bool_(), pa.list_(pa.binary()), pa.list_(pa.binary())]

    def run(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            out = []
            for key, text in distinct_texts([batch]):
                data, n = payload(text)
                each = [(hashlib.sha256(p).digest(), p) for p in pieces(data)]
                own = [None if d in bits.value else packer.compress(p) for d, p in each]
                out.append((key, n, hashlib.sha256(data).digest(), None in own, [d for d, _ in each], own))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return texts.mapInArrow(run, "key binary, n_bytes long, payload_sha binary, refers boolean, digests array<binary>, data array<binary>")


FEATURES = "key binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int"
FEATURE_KINDS = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]


def feature_batch(rows) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, FEATURE_KINDS, strict=True)], names=[c.split()[0] for c in FEATURES.split(", ")])


def rebuilt_alone(stored: DataFrame) -> DataFrame:
    """Features of streams that hold all their chunks."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            yield feature_batch([features(key, n, sha, len(data), [unpack.decompress(x) for x in data]) for key, n, sha, data in zip(*(c.to_pylist() for c in batch.columns), strict=True)])

    return stored.select("key", "n_bytes", "payload_sha", "data").mapInArrow(run, FEATURES)


def rebuilt_joined(stored: DataFrame, shared: DataFrame) -> DataFrame:
    """Features of streams with references: their own and the shared chunks dealt by key and sorted."""
    each = stored.dropDuplicates(["key"]).select("key", "n_bytes", "payload_sha", F.size("digests").alias("n_chunks"), F.posexplode(F.arrays_zip("digests", "data")).alias("seq", "c"))
    each = each.select("key", "n_bytes", "payload_sha", "n_chunks", "seq", F.col("c.digests").alias("digest"), F.col("c.data").alias("own"))
    found = each.where("own is null").drop("own").join(shared, "digest").select("key", "n_bytes", "payload_sha", "n_chunks", "seq", "data")
    dealt = each.where("own is not null").select("key", "n_bytes", "payload_sha", "n_chunks", "seq", F.col("own").alias("data")).union(found).repartition("key").sortWithinPartitions("key", "seq")

    def run(batches):
        unpack, now, parts = zstandard.ZstdDecompressor(), None, []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and row[0] != now[0]:
                    out.append(features(*now[:4], parts))
                    parts = []
                now = row
                parts.append(unpack.decompress(row[5]))
            yield feature_batch(out)
        if now is not None:
            yield feature_batch([features(*now[:4], parts)])

    return dealt.mapInArrow(run, FEATURES)


def features(key: bytes, n: int, payload_sha: bytes, n_chunks: int, parts: list[bytes]) -> tuple:
    data = b"".join(parts)
    sha = hashlib.sha256(data)
    if sha.digest() != payload_sha or n_chunks != len(parts):
        raise ValueError(f"stored media of {key.hex()} is incomplete or altered")
    samples = np.frombuffer(data, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(samples < 0)))
    header = wav_header(len(data))
    feature = f"mean={samples.mean():.6f};rms={np.sqrt((samples**2).mean()):.6f};crossings={crossings}"
    return (key, n, len(data), sha.hexdigest(), zlib.crc32(data[-UNIT:]), len(header) + len(data), hashlib.sha256(header + data).hexdigest(), feature, n_chunks)


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Writes streams and shared chunks into the shared folder; gives both tables and their paths."""
    texts = keyed(docs).select("key", "text")
    with releasing(docs.sparkSession):
        bits = docs.sparkSession.sparkContext.broadcast(shared_filter(texts))
    shared, shared_path = written(shared_rows(texts, bits), "chunks")
    stored, path = written(streams(texts, bits), "streams")
    return stored, shared, [shared_path, path]


def read_back(stored: DataFrame, shared: DataFrame) -> DataFrame:
    return rebuilt_alone(stored.where("not refers")).union(rebuilt_joined(stored.where("refers"), shared))


def features_of(docs: DataFrame) -> DataFrame:
    """doc_id with the digest columns of every row of docs (doc_id, text), through the store."""
    stored, shared, paths = store(docs)
    found, _ = written(read_back(stored, shared).dropDuplicates(["key"]), "media")  # a text may be met twice
    forget(docs.sparkSession, *paths)
    return keyed(docs).select("doc_id", "key").join(found, "key").drop("key")
