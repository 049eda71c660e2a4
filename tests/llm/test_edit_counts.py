from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm import edit_counts as ec
from weft.llm.byte_bpe import codec
from weft.llm.queries import op3_edit_counts, split_pattern, tokenizer_file

BPE = codec(tokenizer_file(), split_pattern())


def count(s):
    return len(BPE.encode(s))


def edited(text, edits):
    for start, length, new in edits:
        start = min(max(start, 0), len(text))
        text = text[:start] + new + text[start + max(length, 0) :]
    return text


WORDS = st.text(alphabet=st.sampled_from(list("ab'sé 1.\n\t漢")), max_size=60)


PIECES = ec.Pieces(tokenizer_file(), split_pattern())


@settings(max_examples=1500, deadline=None)
@given(WORDS, st.lists(st.tuples(st.integers(-3, 80), st.integers(-1, 12), st.text(alphabet=st.sampled_from(list("a' s\n1.漢")), max_size=8)), max_size=6), st.sampled_from([1, 2, 3]))
def test_edits_against_full_count(text, edits, run):
    tree = ec.CountedText(text, PIECES, run)
    for e in edits:
        before = edited(text, [e])
        tree.edit(*e)
        text = before
        assert tree.text() == text
        assert [p for leaf in tree.leaves for p, _ in leaf] == PIECES.split(text)
    assert tree.tokens.total() == count(text) and tree.chars.total() == len(text)


def test_leaves_that_grow_are_split_and_edits_stay_local():
    tree = ec.CountedText("start " * 40, PIECES)
    for k in range(300):
        tree.edit(120, 0, f"new words {k} ")
    assert max(map(len, tree.leaves)) <= 2 * ec.RUN and tree.redone < 300 * 64
    assert tree.tokens.total() == count(tree.text()) and tree.chars.total() == len(tree.text())
    long = ec.CountedText("word " * 100_000, PIECES)
    long.edit(250_000, 3, " and ")
    assert long.redone < 40 and long.tokens.total() == count(long.text())
    solid = ec.CountedText("漢字かな" * 500 + "a1b2" * 500, PIECES)  # no white space anywhere
    solid.edit(900, 10, "x")
    assert solid.tokens.total() == count(solid.text())


def test_query_against_full_count(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op3_edit_counts(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        d = docs[r.doc_id]
        ahead = len(d.source) + 2
        after = edited(d.text, [(0, 0, f"{d.source}: "), (ahead + len(d.text) // 2, 40, " [cut] "), (10**9, 0, "\n-- end")])
        assert (r.n_before, r.n_after, r.chars_after, r.n_edits) == (count(d.text), count(after), len(after), 3)
    assert sum(r.redone for r in rows) < 0.1 * sum(len(d.text) for d in docs.values())


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "s", 1), (2, "", None, 1), (None, "a b", "s", 1), (3, "a b", "s", 1), (3, "a b", "s", 1)], "doc_id long, text string, source string, n_edits int")
    edits = spark.createDataFrame([(3, 2, 0, 1, "z"), (3, 1, None, None, None), (9, 1, 0, 0, "q")], "doc_id long, seq int, start int, length int, text string")
    got = ec.count_edits(ec.with_edits(docs, edits), tokenizer_file(), split_pattern()).collect()
    assert sorted((r.doc_id or 0, r.n_edits, r.chars_after) for r in got) == [(0, 0, 3), (1, 0, 0), (2, 0, 0), (3, 2, 3), (3, 2, 3)]
    assert ec.count_edits(ec.release_edits(docs.limit(0)), tokenizer_file(), split_pattern()).count() == 0
    assert ec.count_edits(ec.release_edits(docs), tokenizer_file(), split_pattern()).count() == 5
