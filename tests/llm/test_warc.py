import hashlib
import zlib

import pytest

from weft.llm import warc
from weft.llm.common import written
from weft.llm.queries import op7_warc


def brute(rows):
    data = [(i, (h or "").encode()) for i, h in rows]
    best = {}
    for i, p in data:
        if len(p) >= 1000 and i is not None:
            best[p] = max(best.get(p, i), i)
    out = []
    for i, p in data:
        to = best.get(p)
        again = to is not None and to != i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", to if again else None))
    return out


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op7_warc(spark, sf_dir).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_edges_and_round_trip(spark):
    big, other = "é" * 600, "x" * 999
    rows = [(1, "http://a/ b", big), (2, None, big), (2, "", big), (None, "u", big), (3, "u", other), (4, "u", other), (5, "u", None), (6, "u", ""), (7, "u", "y" * 1000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, holder string")
    stored, _ = written(warc.archives(pages, archive_bytes=200), "test")
    got = warc.records(stored).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    have = [(int(r.record_id) if r.record_id else None, r.payload_bytes, r.payload_digest, r.record_type, int(r.refers_to) if r.refers_to else None) for r in got]
    assert sorted(have, key=key) == sorted(brute([(r[0], r[2]) for r in rows]), key=key)
    assert {bytes(r.payload).decode() for r in got if r.payload is not None} == {big, other, "", "y" * 1000}
    assert warc.archives(pages.limit(0)).count() == 0


def test_reader_finds_damage():
    whole = warc.record(1, "http://a", b"payload", None) + warc.record(2, None, b"more", 1)
    for piece in (1, 7, 1 << 16):
        assert [r["warc-type"] for r in warc.read(whole, piece)] == ["response", "revisit"]
    with pytest.raises(ValueError, match="within a member"):
        list(warc.read(whole[:-3]))
    text = zlib.decompress(warc.record(1, None, b"payload", None), 31)
    for bad in (text.replace(b"payload", b"pAyload"), text[:-1], text.replace(b"WARC/1.1", b"WORC/1.1")):
        with pytest.raises(ValueError):
            list(warc.read(__import__("gzip").compress(bad)))
