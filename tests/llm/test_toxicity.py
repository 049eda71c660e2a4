import math
import random
import zlib
from collections import Counter

import numpy as np
import xxhash

from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm import toxicity
from weft.llm.queries import op9_toxicity


def brute_segments(scores):
    """Maximal segments by their definition: split around the best segment, again and again."""
    def go(lo, hi):
        best = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > 1e-12 and (best is None or total > best[2] + 1e-12):
                    best = (i, j, total)
        if best is None:
            return []
        return go(lo, best[0]) + [best] + go(best[1] + 1, hi)

    return go(0, len(scores))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-6, 6), max_size=25))
def test_segments_against_definition(raw):
    hits = [(i, x + (i + 1) / 97) for i, x in enumerate(raw) if x]
    scores = [-0.5] * len(raw)
    for i, s in hits:
        scores[i] = s
    got = toxicity.maximal_segments(hits, -0.5)
    want = brute_segments(scores)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want, strict=True))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op9_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["a", "b", "c", "d"], k=30)) + (" vile" * 3 if i % 4 == 0 else ""), 9) for i in range(400)]
    rows += [(None, "vile vile", 9), (900, None, 9), (901, "", 9), (901, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = toxicity.passages(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[0].score >= 0.5 > by[1].score and by[None].score >= 0.5
    assert by[900].score == by[901].score < 0.5
    assert by[0].passages[0].first == 30
    none = toxicity.learn(docs, labels.limit(0))
    assert {r.score for r in toxicity.passages(docs, none).collect()} == {toxicity.probability(none, 0.0)}
    assert toxicity.passages(docs.limit(0), model).count() == 0


def test_scores_do_not_depend_on_partitions(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    scores = []
    for n in (1, 13):
        model = toxicity.learn(docs.repartition(n), labels.repartition(n))
        scores.append({(r.doc_id, r.score) for r in toxicity.passages(docs.repartition(n), model).collect()})
    assert scores[0] == scores[1]


def test_only_copies_are_left_out_of_training(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    near = [(k, passage + " " + " ".join(f"same{j}" for j in range(60)) + f" end{k}", 0) for k in range(6)]
    unlike = [(100 + k, passage + " " + " ".join(f"t{k}x{j}" for j in range(300)), 0) for k in range(20)]
    rows = spark.createDataFrame([(i, k % 97, y, t) for k, (i, t, y) in enumerate(near + unlike + [(200, near[0][1], 1)])], "doc_id long, th long, toxic int, text string")
    kept = {(r.text, r.toxic) for r in toxicity.without_copies(rows).collect()}
    assert {(t, 0) for _, t, _ in unlike} <= kept and (near[0][1], 1) in kept
    assert 1 <= len([t for _, t, _ in near if (t, 0) in kept]) <= 2


def test_very_long_text(spark):
    docs = spark.createDataFrame([(k, ("good words here " if k % 3 else "vile words here ") * 40) for k in range(60)] + [(99, "good words here " * 60_000 + "vile " * 20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.passages(docs, toxicity.learn(docs, labels)).collect()}
    assert got[99].n_tokens == 180_020 and [p.first for p in got[99].passages][-1:] in ([180_000], [])


def test_one_class_scores_by_its_share(spark):
    docs = spark.createDataFrame([(k, "some words here" if k % 2 else "") for k in range(20)], "doc_id long, text string")
    n = toxicity.training_rows(docs, spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, toxic int")).where("text <> ''").count()
    for y in (0, 1):
        model = toxicity.learn(docs, spark.createDataFrame([(k, y) for k in range(20) if k % 2], "doc_id long, toxic int"))
        kept = toxicity.without_copies(toxicity.training_rows(docs, spark.createDataFrame([(k, y) for k in range(20) if k % 2], "doc_id long, toxic int"))).count()
        share = (kept * y + 1) / (kept + 2)
        assert n and {round(r.score, 12) for r in toxicity.passages(docs, model).collect()} == {round(share, 12)}
        assert (share > 0.5) == (y == 1)


def test_the_sample_is_bounded_where_rows_share_an_id(spark):
    docs = spark.createDataFrame([(k % 3, " ".join(f"w{k}x{j}" for j in range(8))) for k in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, toxic int")
    for most, want in ((10, 10), (1000, toxicity.training_rows(docs, labels).count())):
        train, _ = toxicity.sample(docs, labels, most)
        assert train.count() == want


def plain_learn(docs, labels):
    """The model by loops over dicts; the parts that have tests of their own (tokens, features, sketches, segments, curves) are called."""
    marks = {}
    for i, y in labels:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5:
            marks[i] = max(marks.get(i, y), y)
    rows = [(i, x, marks[i]) for i, x in docs if i in marks]
    hashed = lambda x: xxhash.xxh64_intdigest((x or "").encode(), 42)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    seen = {(i, signed(hashed(x)) if x is not None else 42): (x, y, toxicity.sketch(toxicity.tokens(x))) for i, x, y in rows}
    least = {}
    for (i, th), (_, y, s) in seen.items():
        least[y, s[0]] = min(least.get((y, s[0]), (i, th, s)), (i, th, s))
    train = [(x, y) for (i, th), (x, y, s) in seen.items() if least[y, s[0]][:2] == (i, th) or sum(a == b for a, b in zip(s, least[y, s[0]][2])) < toxicity.ALIKE]
    counts = {}
    for x, y in train:
        for f, n in Counter(f for w in toxicity.tokens(x) for f in toxicity.features(w)).items():
            each = counts.setdefault(f, [0, 0, 0])
            each[y > 0] += toxicity.damped(n)
            each[2] += 1
    n0, n1 = (sum(c[k] for c in counts.values()) / 1000 for k in (0, 1))
    found = []
    for f, (c0, c1, texts) in counts.items():
        y0, y1 = c0 / 1000, c1 / 1000
        prior = min(toxicity.PRIOR * (y0 + y1), toxicity.MOST_PRIOR) + toxicity.LEAST_PRIOR
        delta = math.log((y1 + prior) / (n1 - y1 + prior)) - math.log((y0 + prior) / (n0 - y0 + prior))
        z = delta / math.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))
        if abs(z) >= toxicity.MIN_Z and abs(delta) >= toxicity.MIN_LOG_ODDS and texts >= toxicity.MIN_TEXTS:
            found.append((-abs(z), f, delta, y0 / n0))
    found.sort()
    lexicon = {f: d for _, f, d, _ in found}
    lam = toxicity.null_lambda([(d, p) for *_, d, p in found])
    memo = toxicity.Scores(lexicon)
    told = []
    for x, y in train:
        w = toxicity.tokens(x)
        told.append((len(w), y, [s for *_, s in toxicity.maximal_segments(toxicity.hits(w, memo), toxicity.DRIFT)]))
    k = toxicity.gumbel_k(sorted((n, max(s, default=0.0)) for n, y, s in told if y == 0), lam)
    x, y = np.array(sorted((toxicity.evidence(n, [(0, 0, v) for v in s], lam, k), y) for n, y, s in told)).T
    return toxicity.Model(lexicon, lam, k, *toxicity.logistic_fit(x, (y > 0).astype(float)))


def test_query_against_plain_learning_and_scoring(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    model = plain_learn(docs, [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()])
    memo, want = toxicity.Scores(model.lexicon), {}
    for i, x in docs:
        w = toxicity.tokens(x)
        want[i] = toxicity.probability(model, toxicity.evidence(len(w), toxicity.maximal_segments(toxicity.hits(w, memo), toxicity.DRIFT), model.lam, model.k))
    got = {r.doc_id: (r.score, r.predicted, r.held_out) for r in op9_toxicity(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and len(model.lexicon) > 5
    for i, (score, predicted, held_out) in got.items():
        assert abs(score - want[i]) < 1e-6 and predicted == int(score >= 0.5) and held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
