import math
import re
import zlib
from collections import Counter

import numpy as np

from weft.llm import interpolated_lm as lm
from weft.llm.queries import op1_interpolated_lm


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def fold(doc_id):
    return zlib.crc32(str(doc_id if doc_id is not None else "").encode()) % 7


def check(rows, got, model_weights=None):
    train = [tokens(t) for i, t in rows if fold(i) != 2]
    uni, n = Counter(x for t in train for x in t), sum(map(len, train))
    pairs = Counter(p for t in train for p in zip(["<s>", *t], t))
    context = Counter(a for a, b in pairs.elements())
    v = len(uni)
    by = Counter()
    for r in got:
        by[r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens] += 1
    want = Counter()
    for i, t in rows:
        own = tokens(t)
        want[i, fold(i) == 2, len(own), sum(uni[x] > 0 for x in own), n] += 1
    assert by == want
    texts = dict(rows)
    for r in got:
        own = tokens(texts[r.doc_id])
        assert math.isclose(r.base_score, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in own), rel_tol=1e-9)
        if model_weights:
            total = 0.0
            for a, b in zip(["<s>", *own], own):
                h = context[a]
                w = model_weights[min(math.ceil(math.log2(h + 1)), lm.BUCKETS - 1)]
                total += math.log10(w[0] * (pairs[a, b] / h if h else 0) + w[1] * (uni[b] / n if n else 0) + w[2] / (v + 1))
            assert math.isclose(r.score, total, rel_tol=1e-9)


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = op1_interpolated_lm(spark, sf_dir).collect()
    corpus = lm.slices(docs, 20_000).cache()
    answers = lm.answered(lm.asked(corpus, 5)).cache()
    model = lm.learn(corpus, answers)
    check(rows, got)
    sliced = lm.scored(corpus, answers, model).collect()
    check(rows, sliced, model.weights)
    assert np.allclose(sorted(r.score for r in got), sorted(r.score for r in sliced))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_em_finds_the_mixture():
    rng = np.random.default_rng(1)
    events = Counter()
    for _ in range(4000):
        from_pair = rng.random() < 0.7
        pair, token = (40, 10) if from_pair else (0, 30)
        events[5, pair, token] += 1
    w = lm.expectation_maximisation([(*k, n) for k, n in events.items()])
    assert abs(w[5][0] - 0.7) < 0.02 and w[5][1] > 0.25 and abs(sum(w[7]) - 1) < 1e-9


def test_edges(spark):
    rows = [(i, f"a b c{i % 3}") for i in range(40)] + [(41, None), (42, ""), (None, "A\x1cb  É"), (3, "a b c0")]
    docs = spark.createDataFrame([(*r, 2.0) for r in rows], "doc_id long, text string, score double")
    check(rows, lm.score(docs, slice_tokens=16).collect())
    assert lm.score(docs.limit(0)).count() == 0
    only = spark.createDataFrame([(i, "x y") for i in range(60) if fold(i) == 2], "doc_id long, text string")
    got = lm.score(only).collect()
    assert got and all(r.train_tokens == 0 and math.isfinite(r.score) for r in got)


def test_counts_beyond_32_bits():
    assert lm.added(np.array([0, 1, 0]), np.array([2**32 - 1, 3, 6], np.uint32), 2).tolist() == [2**32 + 5, 3]
    rows = [lm.pack(np.array([2**40, 1], np.int64))]
    assert lm.unpack(rows[0], np.int64).tolist() == [2**40, 1]
    assert lm.ratio_cell(np.array([1.0]), 2.0**-50)[0] < lm.ratio_cell(np.array([1.0]), 2.0**-55)[0]


def test_one_very_long_text_and_many_short_ones(spark):
    rows = [(1, "long words of one text " * 30_000)] + [(k, f"w{k % 7}") for k in range(3, 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    check(rows, lm.score(docs, slice_tokens=5000).collect())
