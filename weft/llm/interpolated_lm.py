"""Language-model scoring by deleted interpolation of bigrams, unigrams and a uniform floor.

Tokens: the text's UTF-8 bytes with A-Z lower-cased, split at ASCII white space, then one end token. A token's
maximum-likelihood estimates given its predecessor, alone, and uniform over V + 1 types are mixed with
weights that depend on how often the predecessor was seen (powers of two). The weights come from
expectation-maximisation on held-out counts: a part of the training texts is deleted from the
counts, and its tokens are scored by the rest. Final counts use all training texts.

On Spark: texts become packed slices (about SLICE_TOKENS tokens a row: sorted 64-bit token hashes and the
index of each token), so an n-gram is sent once a slice, not once an occurrence; the deleted texts
have slices of their own. Each slice sends its distinct unigrams and bigrams, with counts, to buckets of the hash
space; a bucket adds up and answers each slice with totals in the order asked. Bucket numbers follow the
number of slices, so a bucket stays bounded, and a word that is everywhere still counts once a slice. EM reads
its held-out events as a table of counts over (context bucket, rounded log-ratios), at most
BUCKETS x GRID x GRID cells whatever the input.

Hash equality stands for token equality (64 bits; bigram keys mix two of them). Null text counts as empty: one end
token. Rows with equal ids and texts score alike; a null id folds as the empty text. Without training tokens, or for
an unseen predecessor, the lower orders take over; the score is finite always.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import fold, forget, written

FOLDS, TEST, DELETED = 7, 2, 3
SLICE_TOKENS = 1_500_000
BUCKETS = 24
GRID = 256
STEP = 4.0  # cells per doubling of a ratio
ROUNDS = 40

START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
TRAIN, HELD_OUT, DEV = 0, 1, 2


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Compressed bytes of an array of whole numbers, byte plane by byte plane; of their steps if they ascend."""
    if ascending:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind, ascending: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    values = np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).reshape(-1)
    return np.cumsum(values, dtype=kind) if ascending else values


def slices(docs: DataFrame, slice_tokens: int = SLICE_TOKENS) -> DataFrame:
    """Rows (slice, ids, roles, sizes, vocabulary, tokens) of whole texts; slices of the deleted part have odd numbers."""
    kind = docs.schema["doc_id"].dataType
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind.simpleString(), pa.string())
    rest = fold(FOLDS)
    role = F.when(rest == TEST, HELD_OUT).when(rest == DELETED, DEV).otherwise(TRAIN)
    given = docs.select("doc_id", docs["text"].cast("string").alias("text"), role.alias("role"))
    schema = pa.schema([("slice", pa.int64()), ("ids", pa.list_(id_type)), ("roles", pa.binary()), ("sizes", pa.binary()), ("vocabulary", pa.binary()), ("tokens", pa.binary())])

    def run(batches):
        count, open_, held_tokens = TaskContext.get().partitionId() << 24, {False: [], True: []}, {False: 0, True: 0}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc_id, text, r in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    each = words(text)
                    h = np.empty(len(each) + 1, np.uint64)
                    h[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, each), np.uint64, len(each))
                    h[-1] = END
                    dev = r == DEV
                    open_[dev].append((doc_id, r, h))
                    held_tokens[dev] += len(h)
                    if held_tokens[dev] >= slice_tokens:
                        yield packed(count, dev, open_[dev])
                        open_[dev], held_tokens[dev], count = [], 0, count + 1
        for dev, held in open_.items():
            if held:
                yield packed(count, dev, held)
                count += 1

    def packed(number, dev, held):
        ids, roles, hashes = zip(*held, strict=True)
        vocabulary, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        sizes = np.array([len(h) for h in hashes], np.uint32)
        row = [2 * number + dev, list(ids), pack(np.array(roles, np.uint8)), pack(sizes), pack(vocabulary, True), pack(tokens.astype(np.uint32))]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types, strict=True)], schema=schema)

    return given.mapInArrow(run, f"slice long, ids array<{kind.simpleString()}>, roles binary, sizes binary, vocabulary binary, tokens binary")


@dataclass
class Slice:
    """A packed row with its distinct bigrams: left and right index into the vocabulary (left = its size: start of text)."""

    roles: np.ndarray
    sizes: np.ndarray
    vocabulary: np.ndarray
    tokens: np.ndarray

    @classmethod
    def of(cls, roles: bytes, sizes: bytes, vocabulary: bytes, tokens: bytes) -> Slice:
        return cls(unpack(roles, np.uint8), unpack(sizes, np.uint32).astype(np.int64), unpack(vocabulary, np.uint64, True), unpack(tokens, np.uint32).astype(np.int64))

    def role_of_token(self) -> np.ndarray:
        return np.repeat(self.roles, self.sizes)

    def left(self) -> np.ndarray:
        out = np.empty_like(self.tokens)
        out[1:] = self.tokens[:-1]
        out[np.cumsum(self.sizes) - self.sizes] = len(self.vocabulary)
        return out

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct bigram keys, and the place of each token's bigram among them."""
        with np.errstate(over="ignore"):
            right = mix(self.vocabulary)
            before = mix(np.append(self.vocabulary, START) * np.uint64(0x9FB21C651E98DF25) + np.uint64(1))
            keys = mix(before[self.left()] + right[self.tokens])
        return np.unique(keys, return_inverse=True)

    def starts(self) -> np.ndarray:
        """The key that carries the count of texts: START, sent among the unigrams."""
        return np.append(self.vocabulary, START)


def asked(corpus: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, slice, kind, keys, train, dev): the distinct n-grams of each slice with their training counts."""
    schema = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("train", pa.binary()), ("dev", pa.binary())])

    def run(batches):
        for batch in batches:
            for number, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = Slice.of(*raw)
                role = s.role_of_token()
                order = np.argsort(s.starts(), kind="stable")
                texts = np.array([np.count_nonzero(s.roles != HELD_OUT), np.count_nonzero(s.roles == DEV)])
                train = np.append(np.bincount(s.tokens[role != HELD_OUT], minlength=len(s.vocabulary)), texts[0])[order]
                dev = np.append(np.bincount(s.tokens[role == DEV], minlength=len(s.vocabulary)), texts[1])[order]
                yield from parts(number, 1, s.starts()[order], train, dev)
                keys, place = s.bigrams()
                yield from parts(number, 2, keys, np.bincount(place[role != HELD_OUT], minlength=len(keys)), np.bincount(place[role == DEV], minlength=len(keys)))

    def parts(number, kind, keys, train, dev):
        cut = np.append(np.searchsorted(keys, bucket_floors(n_buckets)), len(keys))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            x, y = cut[b], cut[b + 1]
            row = [b, number, kind, pack(keys[x:y], True), pack(train[x:y].astype(np.uint32)), pack(dev[x:y].astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types, strict=True)], schema=schema)

    return corpus.select("slice", "roles", "sizes", "vocabulary", "tokens").mapInArrow(run, "bucket int, slice long, kind int, keys binary, train binary, dev binary")


def bucket_floors(n: int) -> np.ndarray:
    """The least key of each of n equal ranges of the 64-bit keys."""
    return np.array([(b << 64) // n for b in range(n)], np.uint64)


def added(place: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """64-bit sums of the slices' 32-bit counts."""
    out = np.zeros(n, np.int64)
    np.add.at(out, place, counts.astype(np.int64))
    return out


def answered(questions: DataFrame) -> DataFrame:
    """(slice, kind, bucket, train, dev): totals for what each slice asked; slice -1 holds N, N of the deleted part, V and its V."""
    schema = pa.schema([("slice", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("train", pa.binary()), ("dev", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        out = []
        for kind in (1, 2):
            rows = [r for r in zip(*(table.column(c).to_pylist() for c in ("bucket", "slice", "kind", "keys", "train", "dev")), strict=True) if r[2] == kind]
            if not rows:
                continue
            each = [unpack(r[3], np.uint64, True) for r in rows]
            keys, train, dev = np.concatenate(each), *(np.concatenate([unpack(r[c], np.uint32) for r in rows]) for c in (4, 5))
            distinct, place = np.unique(keys, return_inverse=True)
            train, dev = (added(place, x, len(distinct)) for x in (train, dev))
            if kind == 1:
                token = distinct != START
                fit = (train - dev)[token]
                stats = np.array([train[token].sum(), fit.sum(), np.count_nonzero(train[token]), np.count_nonzero(fit)], np.int64)
                out.append((-1, 1, rows[0][0], pack(stats), b""))
            ends = np.cumsum([len(x) for x in each])
            for r, a, b in zip(rows, [0, *ends[:-1]], ends, strict=True):
                out.append((r[1], kind, r[0], pack(train[place[a:b]]), pack(dev[place[a:b]])))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return questions.groupBy("bucket").applyInArrow(run, "slice long, kind int, bucket int, train binary, dev binary")


@dataclass
class Counts:
    """Totals for each token of a slice: of the token, of its predecessor as a context, and of the two."""

    token: np.ndarray
    context: np.ndarray
    pair: np.ndarray


def looked_up(s: Slice, answers: list, fit: bool) -> Counts:
    """answers: (kind, bucket, train, dev) of the slice; fit: with the deleted part taken off."""
    both = []
    for kind in (1, 2):
        own = sorted((a for a in answers if a[0] == kind), key=lambda a: a[1])
        total = np.concatenate([unpack(a[2], np.int64) for a in own])
        both.append(total - np.concatenate([unpack(a[3], np.int64) for a in own]) if fit else total)
    single = np.empty(len(s.vocabulary) + 1, np.int64)
    single[np.argsort(s.starts(), kind="stable")] = both[0]
    _, place = s.bigrams()
    return Counts(single[s.tokens], single[s.left()], both[1][place])


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(count + 1)).astype(np.int64), BUCKETS - 1)


@dataclass(frozen=True)
class Model:
    n: int
    v: int
    weights: tuple  # for each context bucket: of pair, of token, of floor


def estimates(c: Counts, n: int, v: int) -> tuple[np.ndarray, np.ndarray, float]:
    return c.pair / np.maximum(c.context, 1), c.token / max(n, 1), 1.0 / (v + 1)


def expectation_maximisation(events: list[tuple[int, int, int, int]], rounds: int = ROUNDS) -> tuple:
    """Weights for each context bucket from (bucket, cell of pair/floor, cell of token/floor, count); cell 0 is probability 0."""
    weights = np.full((BUCKETS, 3), 1 / 3)
    if events:
        bucket, pair, token, count = np.array(events).T
        ratio = np.stack([cell_ratio(pair), cell_ratio(token), np.ones(len(count))], 1)
        for _ in range(rounds):
            share = weights[bucket] * ratio
            share *= (count / share.sum(axis=1))[:, None]
            total = np.full((BUCKETS, 3), 0.1)  # a little mass each, so that no weight reaches 0
            np.add.at(total, bucket, share)
            weights = total / total.sum(axis=1, keepdims=True)
    return tuple(map(tuple, weights.tolist()))


def ratio_cell(p: np.ndarray, floor: float) -> np.ndarray:
    with np.errstate(divide="ignore"):
        cell = np.rint(np.log2(p / floor) * STEP) + 16
    return np.where(p > 0, np.clip(np.nan_to_num(cell, neginf=0), 1, GRID - 1), 0).astype(np.int64)


def cell_ratio(cell: np.ndarray) -> np.ndarray:
    return np.where(cell > 0, np.exp2((cell - 16) / STEP), 0.0)


def with_answers(corpus: DataFrame, answers: DataFrame) -> DataFrame:
    each = answers.where("slice >= 0").groupBy("slice").agg(F.collect_list(F.struct("kind", "bucket", "train", "dev")).alias("answers"))
    return corpus.join(each, "slice")


def learn(corpus: DataFrame, answers: DataFrame) -> Model:
    names = ("n", "n_fit", "v", "v_fit")

    def stats(batches):
        for batch in batches:
            each = [unpack(x, np.int64) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in np.array(each, np.int64).reshape(-1, 4).T], names=names)

    totals = answers.where("slice = -1").select("train").mapInArrow(stats, ", ".join(f"{c} long" for c in names)).agg(*[F.sum(c).alias(c) for c in names]).first()
    n, n_fit, v, v_fit = (x or 0 for x in totals)
    odd = "slice >= 0 and slice % 2 = 1"
    deleted = with_answers(corpus.where(odd), answers.where(odd))

    def run(batches):
        for batch in batches:
            for roles, sizes, vocabulary, tokens, own in zip(*(batch.column(c).to_pylist() for c in ("roles", "sizes", "vocabulary", "tokens", "answers")), strict=True):
                c = looked_up(Slice.of(roles, sizes, vocabulary, tokens), [tuple(a.values()) for a in own], fit=True)
                pair, token, floor = estimates(c, n_fit, v_fit)
                code = (context_bucket(c.context) * GRID + ratio_cell(pair, floor)) * GRID + ratio_cell(token, floor)
                cells, count = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(count)], names=["cell", "n"])

    rows = deleted.select("roles", "sizes", "vocabulary", "tokens", "answers").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    events = [(r.cell // GRID // GRID, r.cell // GRID % GRID, r.cell % GRID, r.n) for r in rows]
    return Model(n, v, expectation_maximisation(events))


def scored(corpus: DataFrame, answers: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    kind = corpus.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        weights = np.array(model.weights)
        for batch in batches:
            for k in range(batch.num_rows):
                roles, sizes, vocabulary, tokens, own = (batch.column(c)[k].as_py() for c in ("roles", "sizes", "vocabulary", "tokens", "answers"))
                s = Slice.of(roles, sizes, vocabulary, tokens)
                c = looked_up(s, [tuple(a.values()) for a in own], fit=False)
                pair, token, floor = estimates(c, model.n, model.v)
                w = weights[context_bucket(c.context)]
                p = w[:, 0] * pair + w[:, 1] * token + w[:, 2] * floor
                first = np.cumsum(s.sizes) - s.sizes
                add = lambda x: np.add.reduceat(x, first)  # noqa: B023, E731
                base = add(np.log10((c.token + 1) / (model.n + model.v + 1)))
                columns = [batch.column("ids")[k].values, s.roles == HELD_OUT, s.sizes, add((c.token > 0).astype(np.int64)), np.full(len(first), model.n), base, add(np.log10(p))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    joined = with_answers(corpus, answers).select("ids", "roles", "sizes", "vocabulary", "tokens", "answers")
    return joined.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, slice_tokens: int = SLICE_TOKENS) -> DataFrame:
    """Learns from docs (doc_id, text) outside the test fold and scores every row."""
    spark = docs.sparkSession
    corpus, corpus_path = written(slices(docs, slice_tokens), "slices")
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), corpus.count())
    answers, answers_path = written(answered(asked(corpus, n_buckets)), "answers")
    result, _ = written(scored(corpus, answers, learn(corpus, answers)), "scores")
    forget(spark, corpus_path, answers_path)
    return result
