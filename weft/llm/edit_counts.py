"""Token counts under edits: a segment tree over the pre-tokens of each document.

A text is split into its pre-tokens, the matches of the tokenizer's pattern, each with its own count of tokens, as no token spans two of
them. Leaves hold runs of at most RUN pre-tokens; two sum trees over the leaves hold their characters and tokens. An edit (start,
length, replacement) descends the character tree, goes back from there to the nearest pre-token that begins with white space after a
non-space, with CONTEXT characters between (no match spans such a place, and none before it looks further), and splits anew from there: the
edited text and some old pre-tokens after it, more of them until a new border meets an old one. From such a border on the old matches stand,
as matching looks at nothing to its left. Only pre-tokens that the splitting changed are encoded again, and the sums
on the paths to the root are updated; leaves that grow beyond twice RUN are cut. Places of an edit
refer to the text after the edits before it; they are clamped to the text.

Null and empty texts have one empty leaf; null edits count as none, null fields of an edit as 0 and "". Each row gives a
row, repeated rows too.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.byte_bpe import codec

RUN = 16
CONTEXT = 2
AHEAD = 4  # old pre-tokens after an edit that are split anew at first
EDITS = "array<struct<start:int,length:int,text:string>>"


class Pieces:
    """Splits a text into pre-tokens and counts the tokens of each."""

    def __init__(self, rank_file: str, pattern: str, memo: int = 200_000):
        self._split, self._encode = regex.compile(pattern).findall, codec(rank_file, pattern).piece
        self._known: dict[str, int] = {}
        self._memo = memo

    def split(self, text: str) -> list[str]:
        return self._split(text)

    def count(self, piece: str) -> int:
        n = self._known.get(piece)
        if n is None:
            n = len(self._encode(piece))
            if len(self._known) < self._memo and len(piece) < 64:
                self._known[piece] = n
        return n


class SumTree:
    """Sums over a power of two of slots, each inner node the sum of its two children."""

    def __init__(self, values: list[int]):
        self.width = 1 << max(len(values) - 1, 0).bit_length()
        self.sums = [0] * self.width + values + [0] * (self.width - len(values))
        for k in range(self.width - 1, 0, -1):
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    def total(self) -> int:
        return self.sums[1]

    def set(self, slot: int, value: int) -> None:
        k = slot + self.width
        change, self.sums[k] = value - self.sums[k], value
        while k > 1:
            k //= 2
            self.sums[k] += change

    def find(self, at: int) -> tuple[int, int]:
        """The slot that holds place at, and the place where that slot begins; the last used slot at the end."""
        k, begin = 1, 0
        at = min(at, self.sums[1] - 1) if self.sums[1] else 0
        while k < self.width:
            k *= 2
            if at - begin >= self.sums[k]:
                begin += self.sums[k]
                k += 1
        return k - self.width, begin


class CountedText:
    """leaves: runs of (pre-token, tokens); redone: characters of pre-tokens that edits had encoded again."""

    def __init__(self, text: str, pieces: Pieces, run: int = RUN):
        self.pieces, self.run, self.redone = pieces, run, 0
        each = [(p, pieces.count(p)) for p in pieces.split(text)]
        self.leaves = [each[k : k + run] for k in range(0, len(each), run)] or [[]]
        self.build()

    def build(self) -> None:
        self.chars = SumTree([sum(len(p) for p, _ in leaf) for leaf in self.leaves])
        self.tokens = SumTree([sum(n for _, n in leaf) for leaf in self.leaves])

    def edit(self, start: int, length: int, text: str) -> None:
        n = self.chars.total()
        start = min(max(start, 0), n)
        end = min(start + max(length, 0), n)
        first, held, at = self.before(start)
        old, last, stop = list(held), first, at + sum(len(p) for p, _ in held)  # pre-tokens from at on, through leaf last, to stop
        ahead = AHEAD
        while True:
            past, k = at, 0  # the old pre-token k begins at past
            while past < end or ahead:
                if k == len(old):
                    if stop == n:
                        break
                    last, more = self.after(last)
                    old += more
                    stop += sum(len(p) for p, _ in more)
                ahead -= past >= end
                past += len(old[k][0])
                k += 1
            whole = "".join(p for p, _ in old[:k])
            region = whole[: start - at] + text + whole[end - at :]
            found = self.pieces.split(region)
            kept, left = self.met(found, old[:k], len(region), len(region) - (past - end), end - at, past == n)
            if kept is not None:
                break
            ahead = 2 * k + AHEAD
        new = [(p, self.pieces.count(p)) for p in found[:kept]]
        self.redone += sum(len(p) for p, _ in new)
        self.put(first, last, self.leaves[first][: len(self.leaves[first]) - len(held)], new + old[left:])

    def before(self, start: int) -> tuple[int, list[tuple[str, int]], int]:
        """The leaf, its pre-tokens and the place from which to split: a border before start that no edit there can move."""
        leaf, begin = self.chars.find(start) if self.chars.total() else (0, 0)
        while True:
            places, at = [], begin
            for k, (p, _) in enumerate(self.leaves[leaf]):
                ahead = self.leaves[leaf][k - 1][0] if k else self.last_before(leaf)
                if at + CONTEXT <= start and p[0] in " \t\n\r" and ahead and not ahead[-1].isspace():
                    places.append((k, at))
                at += len(p)
            if places:
                k, at = places[-1]
                return leaf, self.leaves[leaf][k:], at
            if not leaf:
                return 0, self.leaves[0][:], 0
            leaf -= 1
            begin -= sum(len(p) for p, _ in self.leaves[leaf])

    def last_before(self, leaf: int) -> str:
        while leaf:
            leaf -= 1
            if self.leaves[leaf]:
                return self.leaves[leaf][-1][0]
        return ""

    def after(self, leaf: int) -> tuple[int, list[tuple[str, int]]]:
        """The next leaf that is not empty."""
        leaf += 1
        while not self.leaves[leaf]:
            leaf += 1
        return leaf, self.leaves[leaf]

    def met(self, found: list[str], old: list[tuple[str, int]], size: int, tail: int, end: int, whole: bool) -> tuple[int | None, int]:
        """How many found pre-tokens replace how many old ones: up to the first border that both have from tail on; None if they have none.

        tail: where the text after the edit begins in the region of size characters; end: where it begins in the old one. The last CONTEXT
        characters tell nothing, unless they end the text.
        """
        borders, at = {}, 0
        for k, (p, _) in enumerate(old):
            at += len(p)
            borders.setdefault(at - end + tail, k + 1)
        if tail == end == 0 and not old:
            borders[0] = 0
        at = 0
        for k, p in enumerate(found):
            at += len(p)
            if at >= tail and at in borders and (at <= size - CONTEXT or whole):
                return k + 1, borders[at]
        return (len(found), len(old)) if whole else (None, 0)

    def put(self, first: int, last: int, ahead: list, rest: list) -> None:
        """Leaves first to last hold ahead and rest from now on; unchanged ones keep their sums, more leaves than there were make the trees anew."""
        every = ahead + rest
        parts = [every[k : k + self.run] for k in range(0, len(every), self.run)] if len(every) > 2 * self.run * (last - first + 1) else None
        if parts is not None:
            self.leaves[first : last + 1] = parts
            self.build()
            return
        step = max(self.run, -(-len(every) // (last - first + 1)))
        for k in range(first, last + 1):
            own = every[(k - first) * step : (k - first + 1) * step]
            self.leaves[k] = own
            self.chars.set(k, sum(len(p) for p, _ in own))
            self.tokens.set(k, sum(n for _, n in own))

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p, _ in leaf)


def count_edits(docs: DataFrame, rank_file: str, pattern: str, edits: str = "edits", run_of: int = RUN, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_before, n_after, n_edits, chars_after and redone (characters encoded again) of each row's text and edits."""
    given = docs.select(*keep, docs["text"].cast("string").alias("text_to_count"), docs[edits].cast(EDITS).alias("edits_to_apply"))
    names = [*given.columns[:-2], "n_before", "n_after", "n_edits", "chars_after", "redone"]

    def run(batches):
        pieces = Pieces(rank_file, pattern)
        for batch in batches:
            rows = []
            for text, wanted in zip(*(batch.column(len(keep) + i).to_pylist() for i in range(2)), strict=True):
                counted = CountedText(text or "", pieces, run_of)
                before = counted.tokens.total()
                wanted = [e for e in wanted or [] if e is not None]
                for e in wanted:
                    counted.edit(e["start"] or 0, e["length"] or 0, e["text"] or "")
                rows.append((before, counted.tokens.total(), len(wanted), counted.chars.total(), counted.redone))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *(pa.array(c, pa.int64()) for c in columns)], names=names)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-2])
    return given.mapInArrow(run, f"{kept}, n_before long, n_after long, n_edits long, chars_after long, redone long")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with the edits table (doc_id, seq, start, length, text) gathered into an array column, by seq."""
    each = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "length", "text"))).alias("each"))
    each = each.select("doc_id", F.transform("each", lambda e: F.struct(e["start"].cast("int").alias("start"), e["length"].cast("int").alias("length"), e["text"].alias("text"))).alias("edits"))
    return docs.join(each, "doc_id", "left")


def release_edits(docs: DataFrame) -> DataFrame:
    """The edits of a corpus release: the source is put in front, the middle 40 characters are cut for a mark, the end gets a line."""
    source = F.concat(F.coalesce(docs["source"].cast("string"), F.lit("")), F.lit(": "))
    n, ahead = F.length(F.coalesce(docs["text"].cast("string"), F.lit(""))), F.length(source)
    edits = F.array(
        F.struct(F.lit(0).alias("start"), F.lit(0).alias("length"), source.alias("text")),
        F.struct((ahead + F.floor(n / 2)).cast("int").alias("start"), F.lit(40).alias("length"), F.lit(" [cut] ").alias("text")),
        F.struct((ahead + n + 7).cast("int").alias("start"), F.lit(0).alias("length"), F.lit("\n-- end").alias("text")),
    )
    return docs.select("doc_id", "text", edits.alias("edits"))
