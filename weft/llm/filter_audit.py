"""Filter interaction audit by contractions of contingency tensors.

Each document fails or passes each of five filters. Its outcomes are one of 32 cells, and a part's counts of cells, reshaped, are a tensor of
2 x 2 x 2 x 2 x 2 (pass 0, fail 1). What a step of a filter order does is a contraction of that tensor with one vector
an axis: (1, 0) selects those that pass, (0, 1) those that fail, (1, 1) all. So texts are read once, whatever number of orders is asked for, and the
contractions run on the parts' cells, in tasks.

A document is a copy (E) if a smaller doc_id has the same text anywhere in the table. Texts stand by their SHA-256; the least id of each
is found by a partial aggregate, and rows meet it on (text, doc_id), so no group of copies is one key of a join.

Null texts count as empty ones, null sources as the empty part. A row without doc_id is a copy of none and makes none. Rows that repeat an id and text are
no copies of each other. Of several label rows of one id, any with 1 counts. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import written

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, "#$%&*|"
SPACES = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ("n", "good", "toxic")
PARTS_AT_ONCE = 64

REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
PASS, FAIL, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])


def outcomes(docs: DataFrame) -> DataFrame:
    """(part, doc_id, key, code) of each row: code has bit k set if filter k fails, for all but copies; key is the text's digest."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACES, -1), lambda w: w != "")
    rows = docs.select(F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), "doc_id", text.alias("text"), words.alias("words"))
    count, distinct = F.size("words"), F.size(F.array_distinct("words"))
    size = F.length("text").cast("long")
    capitals = size - F.length(F.translate("text", CAPITALS, ""))
    symbols = F.length(F.translate("text", SYMBOLS, "")) < size
    fails = [count < LEAST_WORDS, distinct.cast("long") * 100 < count.cast("long") * LEAST_DISTINCT, capitals * 100 > size * MOST_CAPITALS, symbols]
    return rows.select("part", "doc_id", F.unhex(F.sha2("text", 256)).alias("key"), _code(fails).alias("code"))


def _code(fails: list[Column]) -> Column:
    total = F.lit(0)
    for k, fail in enumerate(fails):
        total = total + F.when(fail, 1 << k).otherwise(0)
    return total.cast("int")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, code, n, good, toxic): rows of each part by their outcomes under all five filters."""
    rows, _ = written(outcomes(docs), "outcomes")
    first = rows.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    own = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max((F.col("quality") == 1).cast("long")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("toxic"))
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    marked = rows.join(own, "doc_id", "left").join(first, ["key", "doc_id"], "left").select("part", (F.col("code") + F.when(copy, 1 << 4).otherwise(0)).alias("code"), "good", "toxic")
    return marked.groupBy("part", "code").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def tensors(counts: np.ndarray) -> np.ndarray:
    """Parts' counts of cells (parts, 32, measures) as (parts, 2, 2, 2, 2, 2, measures), an axis for each filter in turn."""
    shaped = counts.reshape(len(counts), *[2] * len(FILTERS), counts.shape[-1])  # the highest bit is the first axis
    return shaped.transpose(0, *range(len(FILTERS), 0, -1), len(FILTERS) + 1)


def contracted(tensor: np.ndarray, chosen: list[np.ndarray]) -> np.ndarray:
    """(parts, measures): the sum over the cells that chosen selects along the five axes."""
    return np.einsum("pabcdem,a,b,c,d,e->pm", tensor, *chosen)


def audit(tensor: np.ndarray) -> list[tuple[str, int, dict[str, np.ndarray]]]:
    """(order, step, counts by part) of all steps of all orders of the filters."""
    steps, shapley = [], {f: 0 for f in FILTERS}
    for order in itertools.permutations(range(len(FILTERS))):
        name = "".join(FILTERS[k] for k in order)
        for step, own in enumerate(order):
            chosen = [ALL] * len(FILTERS)
            for before in order[:step]:
                chosen[before] = PASS
            at = lambda select, others=chosen: contracted(tensor, [select if k == own else c for k, c in enumerate(others)])
            removed, every = at(FAIL), at(FAIL, [ALL] * len(FILTERS))
            shapley[FILTERS[own]] = shapley[FILTERS[own]] + removed[:, 0]
            steps.append((name, step + 1, {
                "kept": at(PASS)[:, 0], "removed": removed[:, 0], "redundant": every[:, 0] - removed[:, 0], "unique_fails": at(FAIL, [PASS] * len(FILTERS))[:, 0],
                "good_lost": removed[:, 1], "toxic_lost": removed[:, 2],
            }))
    for name, step, counts in steps:
        counts["shapley"] = shapley[name[step - 1]]
    return steps


def report(found: DataFrame) -> DataFrame:
    """One row for each part, order and step, from cells()."""
    cell = F.struct("code", *MEASURES)
    parts = found.groupBy("part").agg(F.collect_list(cell).alias("cells"))  # 32 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_AT_ONCE):
                yield from told(batch.slice(at, PARTS_AT_ONCE))

    def told(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names, held = batch.column("part"), batch.column("cells")
        counts = np.zeros((batch.num_rows, 1 << len(FILTERS), len(MEASURES)), dtype=np.int64)
        flat = held.flatten()
        row = np.repeat(np.arange(batch.num_rows), held.value_lengths().to_numpy())
        code = flat.field("code").to_numpy()
        for m, measure in enumerate(MEASURES):
            counts[row, code, m] = flat.field(measure).to_numpy()
        for order, step, said in audit(tensors(counts)):
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([names, pa.array([order] * n), pa.array([step] * n, pa.int32()), *[pa.array(said[c], pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]], names=[c.split()[0] for c in REPORT.split(", ")])

    return parts.mapInArrow(run, REPORT)
