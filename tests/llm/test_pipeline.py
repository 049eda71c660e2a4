"""Each stage of the pipeline, and the whole of it, against plain loops over all rows."""

import base64
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken

import corpus_pipeline as cp
from tests_of import brute_links, brute_tiles
from weft.llm import decontaminate, personal_data, toxicity
from weft.llm.queries import split_pattern, tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


def not_toxic(rows, model):
    memo = toxicity.Scores(model.lexicon)
    kept = []
    for r in rows:
        words = toxicity.tokens(r[1])
        segments = toxicity.maximal_segments(toxicity.hits(words, memo), toxicity.DRIFT)
        if toxicity.probability(model, toxicity.evidence(len(words), segments, model.lam, model.k)) < 0.5:
            kept.append(r)
    return kept


def one_of_each(rows):
    """The least id of each group of linked texts; rows without words or id stay, those alike in id and text once."""
    worded = [k for k, r in enumerate(rows) if (r[1] or "").split()]
    group = brute_links([rows[k][1] for k in worded])
    least = {}
    for place, k in enumerate(worded):
        if rows[k][0] is not None:
            least[group[place]] = min(least.get(group[place], rows[k][0]), rows[k][0])
    out, seen = [], set()
    for k, r in enumerate(rows):
        own = ("group", group[worded.index(k)]) if k in worded and r[0] is not None else ("row", r[0], r[1])
        if own not in seen and (own[0] == "row" or r[0] == least[own[1]]):
            seen.add(own)
            out.append(r)
    return out


def without_leaks(rows, items):
    out = []
    for r in rows:
        said, leaked = decontaminate.words(r[1]), False
        for _, text in items:
            own = decontaminate.words(text)
            if not {tuple(own[k : k + 5]) for k in range(len(own) - 4)} & {tuple(said[k : k + 5]) for k in range(len(said) - 4)}:
                continue
            ids = {w: k for k, w in enumerate(dict.fromkeys(own))}
            covered = sum(n for *_, n in brute_tiles([ids.get(w, -1) for w in said], [ids[w] for w in own], 5))
            leaked |= covered >= decontaminate.COVERAGE * len(own)
        out += [] if leaked else [r]
    return out


def masked(rows, weights):
    out = []
    for r in rows:
        base = personal_data.base_spans(r[1])
        text = personal_data.masked(r[1], base + personal_data.added_spans(r[1], base, weights)) if r[1] is not None else None
        out.append((r[0], text, r[2], r[3], len(text) if text is not None else None))
    return out


def stages_against_loops(spark, sf_dir, docs, labels, items):
    """Runs the stages one after another; each must give what its loop gives on its own input."""
    bench = [(r.item_id, r.text) for r in items.collect()]
    for name, stage in cp.STAGES[:-1]:
        before, got = rows_of(docs), stage(spark, docs, sf_dir)
        assert got.columns == docs.columns
        want = {
            "toxicity": lambda: not_toxic(before, toxicity.learn(docs, labels)),  # noqa: B023
            "near_duplicates": lambda: one_of_each(before),  # noqa: B023
            "decontamination": lambda: without_leaks(before, bench),  # noqa: B023
            "personal_data": lambda: masked(before, personal_data.learn(docs)),  # noqa: B023
        }[name]()
        assert Counter(rows_of(got)) == Counter(want), name
        docs = spark.createDataFrame(want, docs.schema)
    return docs


@pytest.fixture(scope="module")
def library():
    with open(tokenizer_file(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=split_pattern(), mergeable_ranks=ranks, special_tokens={})


def test_given_rows(spark, sf_dir, library):
    docs, labels, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    last = stages_against_loops(spark, sf_dir, docs, labels, items)
    want = Counter((r.doc_id, tuple(library.encode_ordinary(r.text or ""))) for r in last.collect())
    got = cp.run(spark, sf_dir)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got.collect()) == want
    assert 0 < len(want) < docs.count() and got.where("n_tokens <> size(ids)").count() == 0


def test_null_repeated_empty_rows_and_empty_tables(spark, sf_dir, tmp_path):
    items = [t for t in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist() if len(t["text"].split()) > 12][:3]
    leak = "See: " + items[0]["text"]
    texts = [(1, "clean words of one document here"), (2, "clean words of one document here"), (2, "another text under the same id two"), (None, leak), (3, leak), (3, "innocent row that shares the id three"), (None, None), (4, None), (5, ""), (5, ""), (6, " \n"),
             (7, "Call +1 (988) 555-2485 now, or 988.555.2485 later"), (None, "clean words of one document here"), (8, "long " * 30_000)]
    docs = [{"doc_id": i, "text": t, "lang": "en", "source": None, "n_chars": None if t is None else len(t)} for i, t in texts]
    labels = [{"doc_id": 1, "quality": 1, "toxic": 0}, {"doc_id": None, "quality": None, "toxic": 1}, {"doc_id": 9, "quality": 1, "toxic": None}]
    schemas = {t: pq.read_schema(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    for name, rows in (("full", (docs, labels, items)), ("empty", ([], [], []))):
        at = tmp_path / name
        at.mkdir()
        for t, each in zip(("documents", "labels", "benchmark"), rows, strict=True):
            pq.write_table(pa.Table.from_pylist(each, schema=pa.schema([f.with_nullable(True) for f in schemas[t]])), f"{at}/{t}.parquet")
        each = [spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels", "benchmark")]
        last = stages_against_loops(spark, str(at), *each)
        assert cp.run(spark, str(at)).count() == last.count() == (10 if name == "full" else 0)
