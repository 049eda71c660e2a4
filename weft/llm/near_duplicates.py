"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Shingles are runs of five lower-cased words (a shorter text is one shingle, a text without words has
none and links to nothing), kept as sorted distinct 64-bit hashes. Texts with equal shingle sets form
one class; everything after that works on classes, so copies never meet in pairs.

Forest: each of TREES tries holds every class under a sequence of minhash labels. The first labels (floor_depth of them:
the most at which 1 - (1 - t^depth)^TREES, the chance that two texts at the threshold t share a prefix, still reaches
the target recall) are one 64-bit key; the next ones, STEPS at most, are a byte each of one integer, so that ordering by (key, rest)
is the trie's order and cutting bytes off the end shortens the prefix. Every class starts at its longest prefix and
shortens it until, at a depth where n other classes share it in some tree, the expected number of partners at the threshold that it still misses,
(1 - t^depth)^TREES, is at most 1 - target of n. So members of crowded branches stop early, in tight
branches, and a lone class goes down to the floor, where every class stops. A branch that is the stop of one of its classes is walked:
its classes become edges to the least class there, which are contracted to one a class and those between hubs; connected classes are found by min-label rounds over id
pairs only, so no branch is ever expanded into pairs.

Verification: a component of n classes is either dealt into blocks of BLOCK classes, or into its branches at the floor (and these into
blocks), whichever moves fewer shingle sets: dense groups go by blocks, long chains by branches. Each pair of blocks
is one cell with both blocks' shingle sets and counts exact intersections with one matrix product a
chunk; a pair that shares several branches counts in the first tree's only. A cell returns the links of each class and a spanning forest
of its links. At least all pairs that share a prefix at the floor within a component are verified.

Rows: one for each input row (repeated rows and null ids too) with class_id, the least id of the rows
that links connect (null only if all their ids are null), n_links, the other rows at or above
the threshold, copies included, and n_text_links, the classes among them. An empty table gives none.
In the graph a class goes by 64 bits of its digest; at 10^10 classes three pairs of classes may be taken for one by chance.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import forget, written

WORDS = 5
THRESHOLD = 0.8
TREES = 24
MAX_DEPTH = 9
STEPS = 4
TARGET_RECALL = 0.9999
BLOCK = 256
SALTS = 16


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, max_depth: int = MAX_DEPTH, target: float = 0.98) -> int:
    """The longest prefix at which two texts at the threshold share one in some tree with the target chance."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def partners_needed(threshold: float, trees: int, target: float, floor: int, steps: int) -> list[int]:
    """For floor, floor + 1, ... labels: how many classes must share the prefix for a class to stop there."""
    return [0, *(math.ceil((1 - threshold ** (floor + j)) ** trees / (1 - target)) for j in range(1, steps + 1))]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of words."""
    each = text.lower().split() if text else []
    if not each:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, each), np.uint64, len(each))
    n = max(len(h) - words + 1, 1)
    with np.errstate(over="ignore"):
        run = np.full(n, min(len(h), words), np.uint64)
        for k in range(min(len(h), words)):
            run = mix(run * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(run)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def multipliers(n: int) -> np.ndarray:
    """Odd 32-bit multipliers, from the golden-ratio sequence through mix()."""
    with np.errstate(over="ignore"):
        return (mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def trie_keys(sh: np.ndarray, factors: np.ndarray, trees: int, floor: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """For each tree a 64-bit key of the first floor labels, and the next labels as bytes of one integer."""
    with np.errstate(over="ignore"):
        x = (sh >> np.uint64(16)).astype(np.uint32)
        low = np.full(trees * (floor + steps), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 2048):
            np.minimum(low, (factors[:, None] * x[None, at : at + 2048]).min(axis=1), out=low)
        labels = low.reshape(trees, floor + steps).astype(np.uint64).T
        key = np.arange(1, trees + 1, dtype=np.uint64)
        for level in labels[:floor]:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + level)
        rest = np.zeros(trees, np.uint32)
        for level in labels[floor:]:
            rest = rest << np.uint32(8) | (mix(level * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint32)
    return key.view(np.int64), rest.view(np.int32)


SIGNED = [("d1", pa.int64()), ("d2", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("rests", pa.list_(pa.int32()))]


def signatures(docs: DataFrame, trees: int, floor: int, steps: int) -> DataFrame:
    """docs' columns but the last, text; the 128-bit digest (d1, d2) of the shingle set, its size n, and the keys of the tries.

    Of equal sets that meet in a slice of rows only the first carries keys.
    """
    factors = multipliers(trees * (floor + steps))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, rows, seen = batch.slice(start, 256), [], set()
                for t in part.column(part.num_columns - 1).to_pylist():
                    sh = shingles(t)
                    both = digest(sh)
                    rows.append((*both, len(sh), *(trie_keys(sh, factors, trees, floor, steps) if len(sh) and both not in seen else (None, None))))
                    seen.add(both)
                columns = [pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), SIGNED, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[*part.schema.names[:-1], *(name for name, _ in SIGNED)])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(run, f"{kept}, d1 long, d2 long, n long, keys array<long>, rests array<int>")


def hashed(docs: DataFrame, *more) -> DataFrame:
    """doc_id, a hash th of the text, and the text, as the last column."""
    text = docs["text"].cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("th"), *more, text.alias("text"))


def digest(sh: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(xxhash.xxh3_128_digest(sh.tobytes()), np.int64).tolist()
    return a, b


def with_sets(members: DataFrame) -> DataFrame:
    """members (the cell columns, then text) with the text replaced by its shingle set sh."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = pa.array([shingles(t).tobytes() for t in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], sets], names=[*part.schema.names[:-1], "sh"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema.fields[:-1])
    return members.mapInArrow(run, f"{kept}, sh binary")


def salted(many: DataFrame, few: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """many joined with few by key, where few has one row a key and a key may hold a large share of many's rows."""
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    each = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("salt", salt).join(each, [key, "salt"], how).drop("salt")


def components(edges: DataFrame, a: str, b: str) -> tuple[DataFrame, list[str]]:
    """(node, label) of an undirected graph of long ids: least id of each component, by min-label rounds with shortcuts."""
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both, first = written(both.union(both.select("y", "x")).distinct(), "edges")
    labels, path = written(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")).withColumnRenamed("x", "node"), "labels")
    paths = [first, path]
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.x).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = step.where("label < node").select(F.col("node").alias("label"), F.col("label").alias("above"))
        up = up.join(step.groupBy("label").agg(F.count(F.lit(1)).alias("members")), "label").select("label", "above")  # only labels that still move
        step = salted(step, up, "label", "node", "left").select("node", "old", F.least("label", "above").alias("label"))
        step, path = written(step, "labels")
        changed = step.where("label <> old").limit(1).count()
        forget(both.sparkSession, paths.pop())
        paths.append(path)
        labels = step.select("node", "label")
        if not changed:
            return labels, paths


def walked_edges(entries: DataFrame, needed: list[int]) -> DataFrame:
    """(d1, hub) of all classes in the branches where a class stops. entries: d1, key, rest, hub and n of the branch at the floor."""
    steps, lone = len(needed) - 1, entries.where(F.col("n") - 1 < (needed[1] if len(needed) > 1 else 2**62)).select("d1", "hub")
    if not steps:
        return lone
    crowd = entries.where(F.col("n") - 1 >= needed[1]).select("d1", "key", "rest")
    at = lambda least: F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.shiftrightunsigned("rest", 8 * (steps - j)).alias("prefix") if j else F.lit(0).alias("prefix")) for j in range(least, steps + 1)])).alias("b")
    leaves = crowd.groupBy("key", "rest").agg(F.count(F.lit(1)).alias("n")).select("key", "rest", "n", at(1)).select("key", "rest", "n", "b.*")
    full = leaves.groupBy("key", "j", "prefix").agg(F.sum("n").alias("size")).where(F.col("size") - 1 >= F.element_at(F.array(*map(F.lit, needed)), F.col("j") + 1))
    stops = leaves.join(full, ["key", "j", "prefix"]).groupBy("key", "rest").agg(F.max("j").alias("stop"))
    of_class = crowd.join(stops, ["key", "rest"]).groupBy("d1").agg(F.max("stop").alias("stop"))
    branches = crowd.join(of_class, "d1", "left").select("d1", "key", F.coalesce("stop", F.lit(0)).alias("stop"), at(0)).select("d1", "key", "stop", "b.*")
    walked = branches.groupBy("key", "j", "prefix").agg(F.min("d1").alias("hub"), F.max("d1").alias("top"), F.min("stop").alias("stop")).where("stop <= j and hub < top")
    return lone.union(branches.drop("stop").join(walked, ["key", "j", "prefix"]).select("d1", "hub"))


def contracted(walked: DataFrame) -> DataFrame:
    """Edges (d1, hub) with the components of walked: each class goes to its least hub, and that one to the class's other hubs, which most classes of a group share."""
    each = walked.groupBy("d1").agg(F.array_sort(F.collect_set("hub")).alias("hubs"))  # at most a hub for each branch of a class
    ends = F.explode(F.concat(F.array(F.struct("d1", F.col("hubs")[0].alias("hub"))), F.transform("hubs", lambda h: F.struct(F.col("hubs")[0].alias("d1"), h.alias("hub")))))
    return each.select(ends.alias("e")).select("e.*").where("d1 <> hub").distinct()


def places(labels: DataFrame, entries: DataFrame, heads: DataFrame, block: int) -> DataFrame:
    """(d1, comp, places, keys): the cells' rows of each class; a place is (key, blocks, block), key 0 for the component as a whole."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    blocks = lambda n: F.ceil(F.col(n) / block)
    large = sizes.where(F.col("size") > block)
    inside = salted(entries.select("d1", "key").join(labels, F.col("d1") == F.col("node")).drop("node"), large.select("label"), "label", "d1")
    branches = inside.groupBy("label", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    cost = branches.groupBy("label").agg(F.sum(F.col("m") * blocks("m")).alias("moved"))
    sizes = sizes.join(cost, "label", "left").select("label", blocks("size").cast("int").alias("blocks"), F.coalesce(F.col("moved") < F.col("size") * blocks("size"), F.lit(False)).alias("by_branch"))
    placed = salted(labels, sizes, "label", "node").select(F.col("node").alias("d1"), F.col("label").alias("comp"), "blocks", "by_branch")
    none = F.lit(None).cast("array<long>")
    whole = placed.where("not by_branch").select("d1", "comp", F.array(F.struct(F.lit(0).cast("long").alias("key"), "blocks")).alias("places"), none.alias("keys"))
    chosen = salted(inside, sizes.where("by_branch").select("label"), "label", "d1").join(branches.select("label", "key", blocks("m").cast("int").alias("blocks")), ["label", "key"])
    chosen = chosen.groupBy("d1", F.col("label").alias("comp")).agg(F.collect_list(F.struct("key", "blocks")).alias("places")).join(heads.select("d1", "keys"), "d1")
    return whole.union(chosen)


def cell_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Index pairs (i < j, one of each side or both sides alike) whose exact Jaccard reaches the threshold."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        inter = np.zeros((2, 2))
        inter[0, 1] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        new = np.append(True, hashes[1:] != hashes[:-1])
        count = np.diff(np.append(np.flatnonzero(new), len(hashes)))
        column = np.cumsum(new) - 1
        shared = (count > 1)[column]
        column, owner = column[shared], owner[shared]
        column = np.cumsum(np.append(False, column[1:] != column[:-1])) if len(column) else column
        inter = np.zeros((len(sets), len(sets)), np.float32)
        cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + 4096, 4096))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                m = np.zeros((len(sets), 4096), np.float32)
                m[owner[a:b], column[a:b] % 4096] = 1
                inter += m @ m.T
    ok = inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-6
    ok &= left[:, None] & right[None, :] | right[:, None] & left[None, :]
    i, j = np.nonzero(np.triu(ok, 1))
    return np.stack([i, j], 1)


def of_this_branch(pairs: np.ndarray, keys: list, key: int) -> np.ndarray:
    """The pairs whose first common key is this one."""
    each = np.array(keys, np.int64)
    first = (each[pairs[:, 0]] == each[pairs[:, 1]]).argmax(axis=1)
    return pairs[each[pairs[:, 0], first] == key]


def forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(least of the group, member) pairs that span the same groups as the links."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [(find(x), x) for x in range(n) if find(x) != x]


def verify(members: DataFrame, threshold: float) -> DataFrame:
    """members: comp, places, d1, d2, copies, keys, sh. Rows: a class's links in a cell, or an edge to another class."""
    placed = members.withColumn("place", F.explode("places")).withColumn("block", F.pmod("d2", "place.blocks").cast("int"))
    cells = (
        placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("place.blocks") - 1)))
        .select("comp", "place.key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "d1", "d2", "copies", "keys", "sh")
    )
    dealt = cells.repartition("comp", "key", "i", "j").sortWithinPartitions("comp", "key", "i", "j", "d1", "d2")

    def run(batches):
        cell, last, rows = None, None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[5:7] == last and row[:4] == cell:
                    continue  # a repeated row
                last = row[5:7]
                if row[:4] != cell:
                    if len(rows) > 1:
                        yield solve(cell, rows)
                    cell, rows = row[:4], []
                rows.append((*row[4:9], np.frombuffer(row[9], np.uint64)))
        if len(rows) > 1:
            yield solve(cell, rows)

    def solve(cell, rows):
        _, key, i, j = cell
        block = np.array([r[0] for r in rows])
        pairs = cell_links([r[5] for r in rows], block == i, block == j, threshold)
        if key and len(pairs):
            pairs = of_this_branch(pairs, [r[4] for r in rows], key)
        copies = np.array([r[3] for r in rows])
        links, texts = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for a, b in ((0, 1), (1, 0)):
            np.add.at(links, pairs[:, a], copies[pairs[:, b]])
            np.add.at(texts, pairs[:, a], 1)
        up = dict((x, r) for r, x in forest(pairs, len(rows)))
        some = [x for x in range(len(rows)) if texts[x]]
        return pa.RecordBatch.from_pydict(
            {"d1": [rows[x][1] for x in some], "d2": [rows[x][2] for x in some], "links": links[some], "texts": texts[some], "to1": [rows[up.get(x, x)][1] for x in some]},
            schema=pa.schema([(c, pa.int64()) for c in ("d1", "d2", "links", "texts", "to1")]),
        )

    return dealt.mapInArrow(run, "d1 long, d2 long, links long, texts long, to1 long")


def classified(docs: DataFrame, threshold: float, trees: int, target: float, block: int, *more) -> tuple[DataFrame, list[str]]:
    """doc_id, th, more columns, n, d2, group, class_id, n_links, n_text_links of every row; rows whose group and d2 (0 where linked) agree are one class."""
    floor = prefix_depth(threshold, trees, MAX_DEPTH, target)
    steps = min(STEPS, MAX_DEPTH - floor)
    sig, sig_path = written(signatures(hashed(docs, *more), trees, floor, steps), "signatures")
    rows = sig.drop("keys", "rests")
    classes = rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "th")).alias("row"))
    heads, heads_path = written(sig.where("keys is not null").select("d1", "d2", "keys", "rests").dropDuplicates(["d1", "d2"]), "heads")

    keyed = heads.select("d1", F.explode(F.arrays_zip("keys", "rests")).alias("k")).select("d1", F.col("k.keys").alias("key"), F.col("k.rests").alias("rest"))
    shared = keyed.groupBy("key").agg(F.min("d1").alias("hub"), F.max("d1").alias("top"), F.count(F.lit(1)).alias("n")).where("hub < top").select("key", "hub", "n")
    entries, entries_path = written(keyed.join(shared, "key").select("d1", "key", "rest", "hub", "n"), "entries")
    edges, edges_path = written(contracted(walked_edges(entries, partners_needed(threshold, trees, target, floor, steps))), "walked")  # components() reads them both ways
    labels, paths = components(edges, "d1", "hub")

    chosen = places(labels, entries, heads, block).join(classes, "d1").select("comp", "places", "d1", "d2", "copies", "keys", "row")
    texts = hashed(docs)
    members = chosen.join(texts, chosen.row.doc_id.eqNullSafe(texts.doc_id) & (chosen.row.th == texts.th)).select("comp", "places", "d1", "d2", "copies", "keys", "text")
    links, links_path = written(verify(with_sets(members), threshold), "links")
    groups, more_paths = components(links, "d1", "to1")
    counts = links.groupBy("d1", "d2").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    linked = (
        classes.join(counts, ["d1", "d2"], "left").join(groups.withColumnRenamed("node", "d1"), "d1", "left")
        .withColumn("group", F.coalesce("label", "d1"))
    )
    least = linked.where("label is not null").groupBy("group").agg(F.min("least_id").alias("group_id"))
    result = salted(linked, least, "group", "d1", "left").select(
        "d1", "d2", "group", F.col("label").isNotNull().alias("is_linked"), F.coalesce("group_id", "least_id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"),
    )
    result, result_path = written(result, "classes")
    final = rows.join(result, ["d1", "d2"]).withColumn("d2", F.when(F.col("is_linked"), 0).otherwise(F.col("d2"))).drop("d1", "is_linked")
    forget(docs.sparkSession, heads_path, entries_path, edges_path, links_path, *paths, *more_paths)
    return final, [sig_path, result_path]


def join(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, target: float = TARGET_RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links and n_text_links of every row of docs (doc_id, text)."""
    found, paths = classified(docs, threshold, trees, target, block)
    wordless = F.col("n") == 0
    final, _ = written(found.select("doc_id", F.when(wordless, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(wordless, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.col("n_text_links").cast("long")), "near")
    forget(docs.sparkSession, *paths)
    return final


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of docs, that with the least id (then least hashes of its text and of its columns); all columns as they are.

    Texts without words are no copies of others, and rows with a null id stay; of either, rows that agree in id and text are one.
    Rows that share an id are told apart by their texts and columns, so none goes for another's sake.
    """
    whole = F.xxhash64(*[F.to_json(F.struct(c)) if "map" in docs.schema[c].dataType.simpleString() else F.col(c) for c in docs.columns])
    found, paths = classified(docs, threshold, TREES, TARGET_RECALL, BLOCK, whole.alias("rh"))
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    mine = F.when(alone, F.struct(F.lit(True).alias("alone"), F.xxhash64("doc_id").alias("a"), F.col("th").alias("b"))).otherwise(F.struct(F.lit(False).alias("alone"), F.col("group").alias("a"), F.col("d2").alias("b")))
    each = found.select(mine.alias("mine"), "doc_id", "th", "rh", F.struct("doc_id", "th", "rh").alias("place"))
    first = each.groupBy("mine").agg(F.min("place").alias("first"))
    salt = F.pmod("rh", F.lit(SALTS)).cast("int")
    marked = each.withColumn("salt", salt).join(first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["mine", "salt"])
    marks = marked.groupBy("doc_id", "th", "rh").agg(F.bool_or(F.col("place").eqNullSafe(F.col("first"))).alias("kept"), F.count(F.lit(1)).alias("rows"))
    marks, marks_path = written(marks.where("not kept or rows > 1").select(F.col("doc_id").alias("of"), "th", "rh", "kept"), "marks")
    forget(docs.sparkSession, *paths)
    name = lambda m: m["of"].eqNullSafe(docs["doc_id"]) & (m["th"] == F.xxhash64(docs["text"].cast("string"))) & (m["rh"] == whole)
    once = docs.join(marks, name(marks), "left_anti")
    several = marks.where("kept")
    return once.union(docs.join(several, name(several), "left_semi").dropDuplicates()) if several.limit(1).count() else once
