import random

from hypothesis import example, given, settings
from hypothesis import strategies as st

from weft.llm import decontaminate
from weft.llm.queries import op2_decontaminate


def brute_tiles(text, item, least):
    free_t, free_i = [x >= 0 for x in text], [x >= 0 for x in item]
    out = []
    while True:
        best = None
        for q in range(len(item)):
            for p in range(len(text)):
                n = 0
                while p + n < len(text) and q + n < len(item) and free_t[p + n] and free_i[q + n] and text[p + n] == item[q + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (p, q, n)
        if best is None:
            return out
        p, q, n = best
        free_t[p : p + n] = [False] * n
        free_i[q : q + n] = [False] * n
        out.append(best)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-1, 3), max_size=30), st.lists(st.integers(0, 3), max_size=20))
@example([1, 0, 1, 0, 0, 0], [1, 0, 1, 1, 0, 0])
def test_tiles_against_brute_force(text, item):
    got, want = decontaminate.tiles(text, item, 2), brute_tiles(text, item, 2)
    assert sorted(x[2] for x in got) == sorted(x[2] for x in want)
    assert got == want


def test_tiles_on_many_random_pairs():
    rng = random.Random(8)
    for _ in range(5000):
        text, item = [rng.randrange(-1, 3) for _ in range(rng.randrange(24))], [rng.randrange(3) for _ in range(rng.randrange(16))]
        assert decontaminate.tiles(text, item, 2) == brute_tiles(text, item, 2)


ITEM = "one two three four five six seven eight nine ten eleven twelve"


def frames(spark):
    swapped = "x y seven eight nine ten eleven twelve filler words here One, two three four five SIX z"
    docs = spark.createDataFrame(
        [(1, swapped, 0.1), (2, "one two three four only five", 0.2), (3, None, 0.3), (4, "", 0.4), (None, ITEM, 0.5), (1, swapped, 0.1), (5, ITEM + " one two", 0.6)],
        "doc_id long, text string, coverage double",
    )
    bench = spark.createDataFrame([(7, ITEM), (8, "too short"), (9, None), (10, "")], "item_id long, text string")
    return docs, bench


def test_reordered_passages_both_ways(spark):
    docs, bench = frames(spark)
    broadcast = sorted(map(tuple, decontaminate.contaminated(docs, bench).fillna(-1).collect()))
    shuffled = sorted(map(tuple, decontaminate.contaminated(docs, bench, max_broadcast_words=0).fillna(-1).collect()))
    assert [r[:2] for r in broadcast] == [(-1, 7), (1, 7), (1, 7), (5, 7)]
    assert broadcast == shuffled
    assert next(r for r in broadcast if r[0] == 1)[2:] == (1.0, 2, 6, 12)
    assert decontaminate.contaminated(docs.limit(0), bench, max_broadcast_words=0).count() == decontaminate.contaminated(docs, bench.limit(0), max_broadcast_words=-1).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_clean_goes_by_the_row_not_by_the_id(spark):
    leak, other = "So: " + ITEM, "words of no item at all in here"
    docs = spark.createDataFrame([(1, leak, "a"), (1, other, "b"), (None, leak, "c"), (None, None, "d"), (2, "", "e"), (1, other, "b")], "doc_id long, text string, leaked string")
    bench = spark.createDataFrame([("i", ITEM), (None, ITEM)], "item_id string, text string")
    for most in (decontaminate.MAX_BROADCAST_WORDS, 0):
        kept = decontaminate.clean(docs, bench, max_broadcast_words=most)
        assert kept.columns == docs.columns and sorted(r.leaked for r in kept.collect()) == ["b", "b", "d", "e"]
        assert decontaminate.contaminated(docs, bench, max_broadcast_words=most).count() == 4


def test_both_ways_on_common_seeds_and_long_texts(spark):
    rng = random.Random(2)
    common = "five very common words here and there"
    items = [(k, " ".join([common, *(f"w{rng.randrange(30)}" for _ in range(20))])) for k in range(12)]
    docs = [(k, f"{common} " + " ".join(rng.choice(items)[1].split()[rng.randrange(3) :]) + " x" * rng.randrange(9)) for k in range(60)]
    docs += [(99, (common + " ") * 5000 + items[3][1]), (98, "a " * 60_000)]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    near, far = (sorted(map(tuple, decontaminate.contaminated(docs, bench, max_broadcast_words=n).collect())) for n in (10**6, 0))
    assert near == far and len(near) > 30 and (99, 3) in {r[:2] for r in near}


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    want = set()
    for i in items:
        own = decontaminate.words(i.text)
        for d in docs:
            said = decontaminate.words(d.text)
            if {tuple(own[k : k + 5]) for k in range(len(own) - 4)} & {tuple(said[k : k + 5]) for k in range(len(said) - 4)}:
                ids = {w: k for k, w in enumerate(dict.fromkeys(own))}
                covered = sum(n for *_, n in brute_tiles([ids.get(w, -1) for w in said], [ids[w] for w in own], 5)) / len(own)
                if covered >= decontaminate.COVERAGE:
                    want.add((d.doc_id, i.item_id))
    got = {(r.doc_id, r.item_id) for r in op2_decontaminate(spark, sf_dir).collect()}
    assert got == want and got


def test_short_items_and_ideographs_both_ways(spark):
    sentence = "今日は天気が良いので散歩に行きました"
    items = [(1, "What's seven times"), (2, sentence), (3, "ok"), (4, "two words"), (5, "a b a b"), (6, "..."), (7, "东京")]
    docs = [(1, "they ask: what s SEVEN times, then"), (2, f"前置き「{sentence}」終わり"), (3, "ok then"), (4, "OK!"), (5, "two words"), (6, "two words more"), (7, "x a b a b y"), (8, "a b b a"), (9, "东京"), (10, "东京大"), (11, "what seven s times"), (12, sentence[:12])]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    for most in (decontaminate.MAX_BROADCAST_WORDS, 0):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, max_broadcast_words=most).collect()}
        assert got == {(1, 1), (2, 2), (4, 3), (5, 4), (7, 5), (9, 7)}
        assert {r.doc_id for r in decontaminate.clean(docs, bench, max_broadcast_words=most).collect()} == {3, 6, 8, 10, 11, 12}
