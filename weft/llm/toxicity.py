"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics.

Learning (a bounded sample of labelled rows, MAX_LABELLED at most, lowest hash of the id first, written once): of
rows that agree in the label and in all of SKETCHES minhashes of five words in a row, the one with the least id (then text hash) is kept, so that
copies do not vouch for each other. Damped counts (n occurrences in a text count DAMPING * ln(1 + n / DAMPING)) of
tokens and of their prefixes of PREFIXES letters in both classes give log-odds with an informative
Dirichlet prior, whose pseudo-counts follow the pooled counts; features with enough z-score,
log-odds and texts form the lexicon, whose size the sample bounds. A token scores as itself, else by its longest prefix in
the lexicon (inflected forms); every other token costs DRIFT.

Scoring: the linear-time scan for all maximal segments over each text. With the null rate of token
scores on clean text, Karlin and Altschul's lambda and K turn the best segment of an m-token text
into E = K m exp(-lambda S); further significant segments multiply in. -ln E passes through a logistic
curve fitted on the same sample.

Null and empty texts have no segment and score by the curve at S = 0. Labels with null are left out,
several labels for an id count as their largest. Where only one class is labelled, or one has no token, every text scores the share of
toxic rows, smoothed by one of each class; with no usable labels every score is 0. Rows of one id with different texts are
all candidates; MAX_LABELLED holds for what is left of these.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import fold, forget, written

MAX_LABELLED = 40_000
PRIOR, MOST_PRIOR, LEAST_PRIOR = 0.1, 2.0, 0.1
PREFIXES = (6, 5, 4)
MEMO = 500_000
MIN_Z = 3.5
MIN_TEXTS, DAMPING = 3, 3.0
SKETCHES, ALIKE = 16, 10
MIN_LOG_ODDS = 1.0
DRIFT = -0.05

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    lam: float
    k: float
    slope: float
    shift: float


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last token, score), in linear time.

    hits: positions and scores of the lexicon tokens, ascending; each other token scores drift (< 0).
    Each stacked segment holds the running totals before and after it, as in Ruzzo and Tompa's scan.
    """
    stack: list[list] = []  # first, last, total before, total after, nearest earlier place with a smaller total before
    total, at = 0.0, 0
    for i, s in hits:
        total += drift * (i - at)
        at = i + 1
        before, total = total, total + s
        if s <= 0:
            continue
        seg = [i, i, before, total, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= seg[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= seg[3]:
                break
            seg[0], seg[2] = stack[j][0], stack[j][2]
            del stack[j:]
        seg[4] = j
        stack.append(seg)
    return [(x[0], x[1], x[3] - x[2]) for x in stack]


def features(word: str) -> list[str]:
    """A token, and its proper prefixes, each with a star."""
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


class Scores(dict):
    """Token scores from the lexicon, 0 without one; remembers up to MEMO tokens."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO:
            self.clear()
        score = self[word] = next((self.lexicon[f] for f in features(word) if f in self.lexicon), 0.0)
        return score


def hits(words: list[str], scores: Scores) -> list[tuple[int, float]]:
    return [(i, s) for i, w in enumerate(words) if (s := scores[w])]


def damped(n: int) -> int:
    """Thousandths of what n occurrences in one text count: further ones ever less, none nothing."""
    return round(1000 * DAMPING * math.log1p(n / DAMPING))


FACTORS = np.arange(1, 2 * SKETCHES, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def sketch(words: list[str]) -> list[int]:
    """SKETCHES minhashes of the runs of five words: two texts agree in about as large a share as they have runs in common."""
    h = np.array([xxhash.xxh3_64_intdigest(" ".join(words[k : k + 5])) for k in range(max(len(words) - 4, 1))], np.uint64)
    with np.errstate(over="ignore"):
        return [int((h * f).min() >> np.uint64(1)) for f in FACTORS]


def evidence(n_tokens: int, segments: list[tuple[int, int, float]], lam: float, k: float) -> float:
    """-ln of the E-value of the best segment, plus what further significant segments add."""
    m = max(n_tokens, 1)
    each = sorted((lam * s - math.log(k * m) for *_, s in segments), reverse=True)
    if not each:
        return max(-30.0, -math.log(k * m) if k * m > 1 else 0.0)
    return max(-30.0, min(60.0, each[0] + sum(x for x in each[1:] if x > 0)))


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of at most max_labelled labelled rows whose id's crc32 mod 5 is not 0."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(5) != 0))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    order = F.xxhash64("doc_id")
    n = chosen.count()
    if n > max_labelled:
        share = 1.2 * max_labelled / n
        chosen = chosen.where((order.cast("double") / 2.0**64 + 0.5) < share) if share < 1 else chosen
    chosen = chosen.orderBy(order, "doc_id").limit(max_labelled)
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "th", "toxic", "text")


def without_copies(rows: DataFrame) -> DataFrame:
    """(text, toxic, doc_id, th) of rows, without those that agree with the least row of their label and first sketch in ALIKE sketches or more."""

    def sketched(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sketch(tokens(t)) for t in batch.column(3).to_pylist()], pa.list_(pa.int64()))], names=[*batch.schema.names, "sketch"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    each = rows.mapInArrow(sketched, f"doc_id {kind}, th long, toxic int, text string, sketch array<long>").withColumn("first", F.col("sketch")[0])
    least = each.groupBy("toxic", "first").agg(F.min(F.struct("doc_id", "th", "sketch")).alias("least"))
    alike = F.size(F.filter(F.zip_with("sketch", "least.sketch", lambda a, b: a == b), lambda same: same))
    itself = (F.col("doc_id") == F.col("least.doc_id")) & (F.col("th") == F.col("least.th"))
    return each.join(least, ["toxic", "first"]).where(itself | (alike < ALIKE)).dropDuplicates(["doc_id", "th"]).select("text", "toxic", "doc_id", "th")


def sample(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, str]:
    """The written training rows, max_labelled at most even where many rows of docs share an id."""
    train, path = written(without_copies(training_rows(docs, labels, max_labelled)), "train")
    if train.count() <= max_labelled:
        return train, path
    chosen = train.select("doc_id", "th").orderBy(F.xxhash64("doc_id", "th"), "doc_id", "th").limit(max_labelled)
    fewer, fewer_path = written(train.join(F.broadcast(chosen), ["doc_id", "th"], "left_semi").select(train.columns), "train")
    forget(docs.sparkSession, path)
    return fewer, fewer_path


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    train, train_path = sample(docs, labels, max_labelled)

    def count(batches):
        for batch in batches:
            both: dict[str, list[int]] = {}
            for text, y in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                for f, n in Counter(f for w in tokens(text) for f in features(w)).items():
                    each = both.setdefault(f, [0, 0, 0])
                    each[y > 0] += damped(n)
                    each[2] += 1
            yield pa.RecordBatch.from_pydict({"token": list(both)} | {c: [x[k] for x in both.values()] for k, c in enumerate(("clean", "toxic", "texts"))}, schema=pa.schema([("token", pa.string()), *((c, pa.int64()) for c in ("clean", "toxic", "texts"))]))

    counts, counts_path = written(train.mapInArrow(count, "token string, clean long, toxic long, texts long").groupBy("token").agg((F.sum("clean") / 1000).alias("y0"), (F.sum("toxic") / 1000).alias("y1"), F.sum("texts").alias("texts")), "counts")
    n0, n1 = (float(n or 0) for n in counts.agg(F.sum(F.col("y0").cast("decimal(30,3)")), F.sum(F.col("y1").cast("decimal(30,3)"))).first())
    if not n0 or not n1:
        rows = {r.toxic: r["count"] for r in train.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
        forget(docs.sparkSession, train_path, counts_path)
        return Model({}, 1.0, 1.0, 0.0, math.log((rows.get(True, 0) + 1) / (rows.get(False, 0) + 1)) if rows else -50.0)
    prior = F.least(PRIOR * (F.col("y0") + F.col("y1")), F.lit(MOST_PRIOR)) + LEAST_PRIOR
    odds = lambda y, n: F.log((F.col(y) + prior) / (F.lit(float(n)) - F.col(y) + prior))
    scored = (
        counts.withColumn("delta", odds("y1", n1) - odds("y0", n0))
        .withColumn("z", F.col("delta") / F.sqrt(1 / (F.col("y1") + prior) + 1 / (F.col("y0") + prior)))
        .where((F.abs("z") >= MIN_Z) & (F.abs("delta") >= MIN_LOG_ODDS) & (F.col("texts") >= MIN_TEXTS))
    )
    top = scored.orderBy(F.abs("z").desc(), "token").collect()  # the sample bounds them
    lexicon = {r.token: r.delta for r in top}
    forget(docs.sparkSession, counts_path)
    lam = null_lambda([(r.delta, r.y0 / n0) for r in top])
    found, found_path = written(train.mapInArrow(lambda it: _statistics(it, lexicon), "toxic int, n long, best double, scores array<double>"), "found")
    best = sorted((r.n, r.best) for r in found.where("toxic = 0").select("n", "best").collect())  # of the sample: MAX_LABELLED rows
    k = gumbel_k(best, lam)
    x, y = np.array(sorted(map(tuple, found.mapInArrow(lambda it: _evidence(it, lam, k), "x double, toxic int").collect()))).T
    slope, shift = logistic_fit(x, (y > 0).astype(float))
    forget(docs.sparkSession, train_path, found_path)
    return Model(lexicon, lam, k, slope, shift)


def _statistics(batches, lexicon):
    memo = Scores(lexicon)
    kinds = {"toxic": pa.int32(), "n": pa.int64(), "best": pa.float64(), "scores": pa.list_(pa.float64())}
    for batch in batches:
        rows = []
        for text, y in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            words = tokens(text)
            scores = [s for *_, s in maximal_segments(hits(words, memo), DRIFT)]
            rows.append((y, len(words), max(scores, default=0.0), scores))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 4, kinds.values(), strict=True)], names=list(kinds))


def _evidence(batches, lam, k):
    for batch in batches:
        x = [evidence(n, [(0, 0, s) for s in scores], lam, k) for n, scores in zip(*(batch.column(c).to_pylist() for c in ("n", "scores")), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column("toxic")], names=["x", "toxic"])


def null_lambda(scores: list[tuple[float, float]]) -> float:
    """The positive root of sum p exp(lambda s) = 1 on clean text; 1 where no positive score occurs there."""
    rest = 1 - sum(p for _, p in scores)
    mean = lambda lam: sum(p * math.exp(min(lam * s, 700)) for s, p in scores) + rest * math.exp(lam * DRIFT) - 1
    if sum(p for s, p in scores if s > 0) <= 0:
        return 1.0
    lo, hi = 1e-6, 5.0
    if mean(lo) >= 0 or mean(hi) <= 0:
        return 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean(mid) < 0 else (lo, mid)
    return lo


def gumbel_k(best: list[tuple[int, float]], lam: float) -> float:
    """Maximum-likelihood K of P(S < x) = exp(-K m exp(-lambda x)), over the best segments of clean texts."""
    total = sum(max(m, 1) * math.exp(-lam * s) for m, s in best)
    return min(10.0, max(1e-6, len(best) / total)) if total else 1.0


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Two-parameter logistic regression by Newton's steps, with a small ridge so that separable data stay finite."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([np.sum((p - y) * x) + ridge * a, np.sum(p - y) + ridge * b])
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[np.sum(w * x * x) + ridge, np.sum(w * x)], [np.sum(w * x), np.sum(w) + ridge]])
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        a, b = (a, b) - step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-9:
            break
    return float(a), float(b)


def probability(model: Model, x: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, model.slope * x + model.shift))))


def passages(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with score, n_tokens and the significant passages (first, last token, segment score)."""
    given = docs.select(*keep, docs[text].cast("string").alias("text_to_score"))
    names = [*given.columns[:-1], "score", "n_tokens", "passages"]

    def run(batches):
        memo = Scores(model.lexicon)
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            scores, sizes, found = [], [], []
            for t in batch.column(len(keep)).to_pylist():
                words = tokens(t)
                segments = maximal_segments(hits(words, memo), DRIFT)
                scores.append(probability(model, evidence(len(words), segments, model.lam, model.k)))
                sizes.append(len(words))
                level = math.log(model.k * max(len(words), 1))
                found.append([{"first": a, "last": b, "score": s} for a, b, s in segments if model.lam * s > level])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array(sizes, pa.int64()), pa.array(found, kind)], names=names)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{kept}, score double, n_tokens long, passages array<struct<first:int,last:int,score:double>>")


def score_column(model: Model, text):
    """The score of a text column, for filters that keep all columns as they are."""

    memo = Scores(model.lexicon)

    @F.pandas_udf("double")
    def score(texts):
        return texts.map(lambda t: probability(model, evidence(len(w := tokens(t)), maximal_segments(hits(w, memo), DRIFT), model.lam, model.k))).astype("float64")

    return score(text)
