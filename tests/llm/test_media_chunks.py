import hashlib
import random
import zlib

import numpy as np

from weft.llm import media_chunks as mc
from weft.llm.queries import op6_media_chunks


def test_gear_hash_against_loop():
    data = np.frombuffer(random.Random(1).randbytes(300), np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = ((h << 1) + int(mc.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert mc.gear_hashes(data).tolist() == want


def test_cuts_follow_content():
    data = np.frombuffer(random.Random(2).randbytes(200_000), np.uint8)
    ends = mc.cuts(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes[:-1].min() >= mc.SMALLEST and sizes.max() <= mc.LARGEST
    shifted = mc.cuts(np.concatenate([np.zeros(777, np.uint8), data]))
    assert len({x + 777 for x in ends} & set(shifted)) > 0.8 * len(ends)
    assert mc.cuts(np.zeros(40_000, np.uint8))[-1] == 40_000


def want(text):
    raw = (text or "").encode()
    data = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
    media = mc.wav_header(len(data)) + data
    return len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest()


def got(r):
    return r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256


def test_query_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op6_media_chunks(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    assert all(got(r) == want(texts[r.doc_id]) for r in rows)


def test_edges_and_shared_chunks(spark):
    long = "".join(random.Random(3).choices("abcdefgh ", k=150_000))
    rows = [(1, None), (2, ""), (3, "x" * 64), (4, "é"), (None, long), (5, "front " + long), (5, "front " + long)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, digest string")
    out = mc.features_of(docs).collect()
    assert sorted(map(got, out)) == sorted(want(t) for _, t in rows)
    stored, shared, _ = mc.store(docs)
    total = sum(r.n for r in stored.dropDuplicates(["key"]).selectExpr("size(digests) n").collect())
    kept = shared.count() + sum(r.n for r in stored.selectExpr("size(filter(data, x -> x is not null)) n").collect())
    assert kept < 0.6 * total
    assert mc.features_of(docs.limit(0)).count() == 0


def test_filter_holds_every_shared_digest_and_few_others(spark, monkeypatch):
    monkeypatch.setattr(mc, "LEAST_BITS", 8)
    assert [mc.filter_size(n) for n in (0, 1, 17, 1000, 10**7, 10**12)] == [8, 8, 9, 14, 28, 28]
    monkeypatch.undo()
    texts = [f"text {k} " * 20 for k in range(3000)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts + texts[:400])], "doc_id long, text string").repartition(5, "doc_id")  # by id, so that both plans deal alike
    keyed = mc.keyed(docs).select("key", "text")
    found = mc.shared_filter(keyed)
    digest = lambda t: hashlib.sha256(mc.payload(t)[0]).digest()
    parts = docs.rdd.glom().map(lambda rows: [r.text for r in rows]).collect()
    met = {}  # a batch tells a text once, however often it holds it
    for i, p in enumerate(parts):
        for t in p:
            met.setdefault(t, set()).add(i)
    shared = [t for t, where in met.items() if len(where) > 1]
    assert sum(map(len, parts)) == 3400 and len(shared) > 100 and all(digest(t) in found for t in shared)
    assert sum(digest(t) in found for t in texts if t not in set(shared)) < 0.2 * len(texts)
