"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching.

Words (runs of letters, digits and underscores, lower-cased; each ideograph or kana is one) are the tokens. Texts and benchmark items
that share a run of SEED words (of all its words, for a shorter item), found by a join on the runs' hashes, become candidate pairs. For each pair the
longest common run of unmarked words is marked as a tile, again and again, down to the seed's words; equal
lengths go by the earlier place in the item, then in the text. An item whose words are covered to COVERAGE or more is
leaked in that text, whatever order its passages come in.

The seed join: while the benchmark holds at most MAX_BROADCAST_WORDS words (counted first), its items are
broadcast and matched in the scan of the texts. Beyond that, hashes of both sides are joined in Spark, salted and
without those seeds of each item that most texts have (as many as a leaking text can do without), and the pairs found get their
texts by joins; both ways give the same rows.

Null and empty texts and items without words match nothing. An item of fewer than WHOLE words says too little for a passage: it leaks
in texts that have these words and no others. A repeated row or item gives its pair
again. Rows: doc_id, item_id, coverage, tiles, longest, item_words of each pair at or above COVERAGE.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weft.llm.common import written

SEED = 5
WHOLE = 3
COVERAGE = 0.8
MAX_BROADCAST_WORDS = 2_000_000
SALTS = 16

IDEOGRAPHS = r"\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
WORD = re.compile(rf"[{IDEOGRAPHS}]|[^\W{IDEOGRAPHS}]+")
BASE, PRIME = 1_000_003, (1 << 61) - 1


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def tiles(text: list[int], item: list[int], least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiling: (place in text, place in item, length), longest first. Negative ids match nothing.

    Each round slides Karp-Rabin hashes of the least length over unmarked runs, extends every hit
    over unmarked words, and marks the longest ones that do not overlap a tile of the round; a hit that does is
    tried again, trimmed, in the next round.
    """
    free_t, free_i = [x >= 0 for x in text], [x >= 0 for x in item]
    out = []
    while True:
        at = defaultdict(list)
        for p, h in rolling(text, free_t, least):
            at[h].append(p)
        found = []
        for q, h in rolling(item, free_i, least):
            for p in at.get(h, ()):
                if p and q and free_t[p - 1] and free_i[q - 1] and text[p - 1] == item[q - 1]:
                    continue  # part of a longer match that began before
                n = 0
                while p + n < len(text) and q + n < len(item) and free_t[p + n] and free_i[q + n] and text[p + n] == item[q + n]:
                    n += 1
                if n >= least:
                    found.append((-n, q, p))
        if not found:
            return out
        found.sort()
        longest_left = None
        for n, q, p in found:
            n = -n
            if longest_left is not None and n <= longest_left:
                break  # a trimmed match may now be longer than this one, or as long and earlier
            if all(free_t[p : p + n]) and all(free_i[q : q + n]):
                free_t[p : p + n] = [False] * n
                free_i[q : q + n] = [False] * n
                out.append((p, q, n))
            else:
                left = trimmed(p, q, n, free_t, free_i)
                if left >= least:
                    longest_left = max(longest_left or 0, left)


def trimmed(p: int, q: int, n: int, free_t: list[bool], free_i: list[bool]) -> int:
    """Longest run of a match that is still unmarked on both sides."""
    best = run = 0
    for k in range(n):
        run = run + 1 if free_t[p + k] and free_i[q + k] else 0
        best = max(best, run)
    return best


def rolling(ids: list[int], free: list[bool], n: int):
    """(place, Karp-Rabin hash) of every run of n free ids, each hash from the one before."""
    top, h, run = pow(BASE, n - 1, PRIME), 0, 0
    for k, x in enumerate(ids):
        if not free[k]:
            h = run = 0
            continue
        if run == n:
            h -= (ids[k - n] + 1) * top
            run -= 1
        h = (h * BASE + x + 1) % PRIME
        run += 1
        if run == n:
            yield k - n + 1, h


class Benchmark:
    """Items as ids of their own vocabulary, with the sorted hashes of their seeds by length: some 20 bytes a word."""

    def __init__(self, items: list[tuple], seed: int):
        self.seed, self.ids, self.items = seed, {}, []
        hashes, owners = defaultdict(list), defaultdict(list)
        for item_id, text in items:
            ids = np.array([self.ids.setdefault(w, len(self.ids)) for w in words(text)], np.int32)
            if len(ids):
                least = min(seed, len(ids))
                found = np.unique(runs(ids.astype(np.int64), least)[1])
                hashes[least].append(found)
                owners[least].append(np.full(len(found), len(self.items), np.int32))
                self.items.append((item_id, ids))
        self.seeds = {}
        for least, each in hashes.items():
            every = np.concatenate(each)
            order = np.argsort(every, kind="stable")
            self.seeds[least] = every[order], np.concatenate(owners[least])[order]

    def leaks(self, text: str | None, coverage: float) -> list[tuple]:
        ids = np.fromiter(map(self.ids.get, each := words(text), [-1] * len(each)), np.int64, len(each))
        met = []
        for least, (seeds, owners) in self.seeds.items():
            hashes = np.unique(runs(ids, least)[1])
            low, high = np.searchsorted(seeds, hashes), np.searchsorted(seeds, hashes, side="right")
            met += [owners[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True) if b > a]
        out = []
        for k in np.unique(np.concatenate(met)).tolist() if met else ():
            item_id, item = self.items[k]
            if row := leak(ids.tolist(), item.tolist(), self.seed, coverage):
                out.append((item_id, *row))
        return out


def leak(text: list[int], item: list[int], seed: int, coverage: float) -> tuple | None:
    """(coverage, tiles, longest, item words), or None below the coverage."""
    if len(item) < WHOLE and len(text) > len(item):
        return None
    own = set(item)
    found = tiles([x if x in own else -1 for x in text], item, min(seed, len(item)))
    covered = sum(n for *_, n in found) / len(item)
    return (covered, len(found), found[0][2], len(item)) if found and covered >= coverage else None


def runs(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs of n ids none of which is negative."""
    if len(ids) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    bad = np.cumsum(np.append(0, ids < 0))
    at = np.flatnonzero(bad[n:] == bad[:-n])
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[at + k].astype(np.uint64) + np.uint64(1)
            h ^= h >> np.uint64(29)
    return at, h


SCHEMA = "coverage double, tiles int, longest int, item_words int"


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")


def fits(items: DataFrame, max_broadcast_words: int) -> bool:
    ideographs = F.length("text") - F.length(F.regexp_replace("text", f"[{IDEOGRAPHS}]", ""))
    return (items.agg(F.sum(F.size(F.split("text", r"[^\p{L}\p{N}_]+")) + ideographs)).first()[0] or 0) <= max_broadcast_words


def held(items: DataFrame, seed: int):
    """The broadcast items; called only behind fits()."""
    return items.sparkSession.sparkContext.broadcast(Benchmark(sorted(items.collect(), key=lambda r: (r[0] is None, str(r[0]), r[1])), seed))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, max_broadcast_words: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """doc_id, item_id, coverage, tiles, longest, item_words of every pair whose item is covered to coverage or more."""
    items = benchmark_items(benchmark)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    if not fits(items, max_broadcast_words):
        return _by_shuffle(texts, items, coverage, seed)
    bench = held(items, seed)
    doc_kind, item_kind = texts.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    item_type = to_arrow_type(items.schema["item_id"].dataType)

    def run(batches):
        b = bench.value
        for batch in batches:
            rows, at = [], []
            for k, t in enumerate(batch.column(1).to_pylist()):
                for row in b.leaks(t, coverage):
                    at.append(k)
                    rows.append(row)
            yield _batch(batch.column(0).take(pa.array(at, pa.int64())), item_type, rows)

    return texts.mapInArrow(run, f"doc_id {doc_kind}, item_id {item_kind}, {SCHEMA}")


def _batch(ids, item_type, rows) -> pa.RecordBatch:
    kinds = (item_type, pa.float64(), pa.int32(), pa.int32(), pa.int32())
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "item_id", "coverage", "tiles", "longest", "item_words"])


def seed_rows(df: DataFrame, key: str, seed: int, short: list[int] | None = None) -> DataFrame:
    """(key, hash, n, size, least) of the distinct seeds of each row's text; n: in how many places, size: of how many words the text is.

    Of items (short None) the seeds are of least words, seed or all that a shorter one has; of texts, of seed words and of the short lengths.
    """

    def run(batches):
        for batch in batches:
            columns = [[np.empty(0, np.int64)] for _ in range(5)]
            for k, t in enumerate(batch.column(1).to_pylist()):
                each = words(t)
                ids = (np.fromiter(map(xxhash.xxh3_64_intdigest, each), np.uint64, len(each)) >> np.uint64(1)).astype(np.int64)
                for least in [seed, *short] if short is not None else [min(seed, len(each))]:
                    if least:
                        found, places = np.unique(runs(ids, least)[1], return_counts=True)
                        for c, x in zip(columns, (np.full(len(found), k), found.view(np.int64), places, np.full(len(found), len(each)), np.full(len(found), least)), strict=True):
                            c.append(x)
            at, *rest = (np.concatenate(c) for c in columns)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *map(pa.array, rest)], names=["key", "hash", "n", "size", "least"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "text").mapInArrow(run, f"key {kind}, hash long, n long, size long, least long")


def telling_seeds(of_texts: DataFrame, of_items: DataFrame, coverage: float) -> DataFrame:
    """(hash, least, ik) of the item seeds of which every leaking text shares one at least.

    A text that covers coverage x size words of an item by tiles of least words or more shares at least coverage x size / least
    of its seed places. So the places of the seeds that most texts have may go, as long as fewer than that go.
    """
    common = of_texts.groupBy("hash", "least").agg(F.count(F.lit(1)).alias("texts"))
    ranked = of_items.join(common, ["hash", "least"]).withColumn("gone", F.sum("n").over(Window.partitionBy("key").orderBy(F.desc("texts"), "hash")))
    return ranked.where(F.col("gone") >= F.ceil(F.col("size") * coverage / F.col("least") - 1e-9)).select("hash", "least", F.col("key").alias("ik"))


def _by_shuffle(texts: DataFrame, items: DataFrame, coverage: float, seed: int) -> DataFrame:
    """Row keys are hashes of id and text: rows that share one meet the same items, and every pair is verified."""
    texts, items = (df.withColumn("rk", F.xxhash64(df.columns[0], "text")) for df in (texts, items))
    of_items = seed_rows(items.dropDuplicates(["rk"]), "rk", seed)
    short = sorted(r.least for r in of_items.where(F.col("least") < seed).select("least").distinct().collect())  # below seed
    wanted = of_items.select("hash", "least").distinct()
    of_texts, _ = written(seed_rows(texts.dropDuplicates(["rk"]), "rk", seed, short).join(wanted, ["hash", "least"], "left_semi").select("hash", "least", "key"), "seeds")
    telling = telling_seeds(of_texts, of_items, coverage).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = of_texts.select("hash", "least", F.col("key").alias("rk"), F.pmod("key", F.lit(SALTS)).cast("int").alias("salt"))
    pairs = salted.join(telling, ["hash", "least", "salt"]).select("rk", "ik").distinct()
    full = pairs.join(texts.select("rk", "doc_id", "text"), "rk").join(items.select(F.col("rk").alias("ik"), "item_id", F.col("text").alias("item")), "ik")

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for k, (t, i, item) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                ids: dict[str, int] = {}
                bench = [ids.setdefault(w, len(ids)) for w in words(item)]
                if row := leak([ids.get(w, -1) for w in words(t)], bench, seed, coverage):
                    at.append(k)
                    rows.append((i, *row))
            yield _batch(batch.column(0).take(pa.array(at, pa.int64())), batch.schema.field(2).type, rows)

    doc_kind, item_kind = texts.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    return full.select("doc_id", "text", "item_id", "item").mapInArrow(run, f"doc_id {doc_kind}, item_id {item_kind}, {SCHEMA}")


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, max_broadcast_words: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """docs without the rows whose own text holds a leaked item, whatever their ids; rows of null texts stay."""
    items, text = benchmark_items(benchmark), docs["text"].cast("string")
    if fits(items, max_broadcast_words):
        bench = held(items, seed)

        @F.pandas_udf("boolean")
        def leaky(texts):
            return texts.map(lambda t: bool(bench.value.leaks(t, coverage))).astype(bool)

        return docs.where(~leaky(text))
    name = lambda t: F.sha2(t, 256)
    each = docs.select(text.alias("text")).where("text is not null").select(F.unhex(name(F.col("text"))).alias("doc_id"), "text")
    leaked = _by_shuffle(each, items, coverage, seed).select(F.col("doc_id").alias("leaked")).distinct()
    return docs.join(leaked, F.unhex(name(text)) == leaked.leaked, "left_anti")
