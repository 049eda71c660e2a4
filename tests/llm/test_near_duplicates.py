import random
from collections import defaultdict

import numpy as np

from weft.llm import near_duplicates as nd
from weft.llm.queries import op10_near_duplicates


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    return out


def brute(rows):
    """class_id and n_links of each row, from all pairs."""
    sets = sets_of([t for _, t in rows])
    links = defaultdict(set)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a].add(b)
                links[b].add(a)
    label, out = {}, {}
    for a in range(len(rows)):
        todo, seen = [a], {a}
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out[a] = (min(rows[x][0] for x in seen), len(links[a]))
    return out


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {rows[a][0]: x for a, x in brute(rows).items()}
    got = {r.doc_id: (r.class_id, r.n_links) for r in op10_near_duplicates(spark, sf_dir).collect()}
    assert got == want


def test_large_near_group_in_blocks(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = []
    for i in range(60):
        own = list(base)
        own[rng.randrange(200)] = f"v{i % 40}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(50))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {rows[a][0]: x for a, x in brute(rows).items()}
    got = {r.doc_id: (r.class_id, r.n_links) for r in nd.join(docs, block=8).collect()}
    assert got == want
    assert {r.doc_id for r in nd.keep_one(docs).collect()} == {0, *range(100, 120)}


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "two words", "a"), (4, "Two  words", "b"), (4, "Two  words", "b"), (None, "six words are in this text", "a"), (7, "six words are in this text", "a"), (8, " \n ", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = sorted((r.doc_id or 0, r.class_id, r.n_links) for r in nd.join(docs).collect())
    assert got == [(0, 7, 1), (1, 1, 0), (2, 2, 0), (3, 3, 2), (4, 3, 2), (4, 3, 2), (7, 7, 1), (8, 8, 0)]
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 7, 8]
    assert nd.join(docs.limit(0)).count() == 0


def test_rows_that_share_ids_and_columns_that_differ(spark):
    rows = [(1, "some words of text a here", "x"), (2, "some words of text a here", "x"), (2, "quite another text that stays", "x"), (3, "one more text of its own", "b"), (3, "one more text of its own", "a"), (3, "one more text of its own", "a")]
    rows += [(None, "null ids stay as they are", "x"), (None, "null ids stay as they are", "x"), (None, None, "x"), (4, "", "x"), (4, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = sorted(map(str, map(tuple, nd.keep_one(docs).collect())))
    one = [r for r in rows if r[0] == 3 and str(r) in kept]
    assert len(one) and kept == sorted(map(str, [rows[0], rows[2], one[0], rows[6], rows[8], rows[9]]))
    assert kept == sorted(map(str, map(tuple, nd.keep_one(docs.repartition(7)).collect())))
    assert nd.keep_one(docs.limit(0)).count() == 0


def chain_rows(n, words=100, shift=3):
    return [(i, " ".join(f"c{k}" for k in range(i * shift, i * shift + words))) for i in range(n)]


def test_chain_goes_by_branches(spark):
    """Each text is like the next ones only; the whole is one class, and no block holds it."""
    rows = chain_rows(100, shift=9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {rows[a][0]: x for a, x in brute(rows).items()}
    assert {r.doc_id: (r.class_id, r.n_links) for r in nd.join(docs, block=3).collect()} == want
    assert want[0] == (0, 1) and want[99][0] == 0
    floor = nd.prefix_depth(target=nd.TARGET_RECALL)
    sig = nd.signatures(nd.hashed(docs), nd.TREES, floor, nd.STEPS).cache()
    keyed = sig.selectExpr("d1", "explode(keys) key", "0 rest")
    entries = keyed.join(keyed.groupBy("key").agg({"d1": "count"}).where("`count(d1)` > 1").select("key"), "key")
    labels = sig.selectExpr("d1 node", "1L label")
    keys = [r.keys for r in nd.places(labels, entries, sig, 3).collect()]
    assert len(keys) == 100 and all(k is not None for k in keys)


def test_crowded_branches_stop_early(spark):
    """Classes with many partners keep long prefixes: their short ones add no edges; lone ones go down to the floor."""
    needed = [0, 3, 5, 9, 17]
    crowd = [(i, 7, 0x01020300 + i % 2) for i in range(20)]  # ten in each leaf: enough three labels below the floor
    entries = spark.createDataFrame([(*r, 0, 20) for r in crowd] + [(100, 8, 1, 100, 2), (101, 8, 2, 100, 2)], "d1 long, key long, rest int, hub long, n long")
    edges = {(r.d1, r.hub) for r in nd.walked_edges(entries, needed).collect()}
    assert edges >= {(100, 100), (101, 100)} and {(i, 0) for i in range(20)} <= edges
    apart = [(i, 7, (1 if i < 10 else 2) << 24) for i in range(20)]  # two branches of ten that part at the first label below the floor
    edges = {(r.d1, r.hub) for r in nd.walked_edges(spark.createDataFrame([(*r, 0, 20) for r in apart], "d1 long, key long, rest int, hub long, n long"), needed).collect()}
    assert edges == {(i, 0 if i < 10 else 10) for i in range(20)}
    for j, n in enumerate(nd.partners_needed(0.8, 24, 0.9999, 5, 4)):
        missed = (1 - 0.8 ** (5 + j)) ** 24
        assert j == 0 or n * 0.0001 >= missed - 1e-12 > (n - 1) * 0.0001


def test_very_long_and_many_empty_texts(spark):
    long = " ".join(f"w{k % 5000}x{k // 7}" for k in range(60_000))
    rows = [(1, long), (2, long + " one two three"), (3, "z " * 50_000), (4, "Z " * 49_999), *((10 + i, "") for i in range(50))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in nd.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (3, 1)} | {10 + i: (10 + i, 0) for i in range(50)}


def test_depth_and_minhash():
    assert nd.prefix_depth() == 8 and nd.prefix_depth(target=0.999) < 8
    a = nd.shingles(" ".join(f"w{i}" for i in range(400)))
    assert len(a) == 396 and (np.diff(a.view(np.int64).astype(object)) != 0).all()


def test_lone_pairs_near_the_threshold(spark):
    rows = []
    for i in range(600):
        own = [f"p{i}w{k}" for k in range(104)]
        shared = 93 + i % 3  # of 100 shingles each 89 to 91 are shared: Jaccard 0.80 to 0.83
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[:shared] + [f"q{i}w{k}" for k in range(shared, 104)]))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in nd.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (k - k % 2, 1) for k in range(1200)}


def test_edges_of_a_group_grow_by_one_a_class(spark):
    """A class of a dense group has another hub in each tree; only one edge a class is kept, with those between hubs, and components are the same."""
    n, trees = 300, 24
    rows = [(1000 + d, t if d % trees else 500 + t) for d in range(n) for t in range(trees)] + [(t, t) for t in range(trees)] + [(5000, 4000), (4000, 4000)]
    walked = spark.createDataFrame(rows, "d1 long, hub long")
    edges = nd.contracted(walked)
    assert edges.count() <= n + 3 * trees
    label = lambda e: {r.node: r.label for r in nd.components(e, "d1", "hub")[0].collect()}
    assert label(edges) == label(walked)
