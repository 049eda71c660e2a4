import itertools
import re

from weft.llm import filter_audit
from weft.llm.queries import op12_filter_audit


def brute(docs, labels):
    """Every order applied to the documents, one filter after another."""
    rows = []
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    for i, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        rows.append((source or "", fails, i in good, i in toxic))
    out, total = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                every = [r for r in rows if r[0] == part and r[1][f]]
                left = [r for r in left if not r[1][f]]
                out[part, order, step] = [len(left), len(gone), len(every) - len(gone), sum(sum(r[1].values()) == 1 for r in every), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                total[part, f] = total.get((part, f), 0) + len(gone)
    return {(*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_query_against_all_orders(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = op12_filter_audit(spark, sf_dir).collect()
    assert len(got) == len({r[2] for r in docs}) * 600
    assert {tuple(r) for r in got} == brute(docs, labels)


def test_edges(spark):
    words = " ".join(f"w{k}" for k in range(60))
    docs = [(1, words, "a"), (2, words, "a"), (2, words, "b"), (1, words, "a"), (None, words, "b"), (3, None, None), (4, "", ""), (5, "A B C # " * 40, "b"), (6, "É" * 10 + "Z", "b"), (7, "x\x0by\u00a0z\u2003" * 80, "a"), (8, "\t\n" + words + " ", "a"),
            (None, None, None), (9, "word " * 200_000, "b"), (10, "word " * 200_000, "a")]
    labels = [(1, 1, 0), (1, 0, 0), (2, None, 1), (None, 1, 1), (9, 1, 1), (99, 1, 1), (4, None, None)]
    frame = spark.createDataFrame([(*r, 1, "k") for r in docs], "doc_id long, text string, source string, code int, key string")
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = [tuple(r) for r in filter_audit.report(filter_audit.cells(frame, marks)).collect()]
    assert len(got) == len(set(got)) == 3 * 600 and set(got) == brute(docs, labels)
    assert filter_audit.report(filter_audit.cells(frame.limit(0), marks)).collect() == []
    assert {tuple(r) for r in filter_audit.report(filter_audit.cells(frame, marks.limit(0))).collect()} == brute(docs, [])
