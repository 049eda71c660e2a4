"""URL filters by a bit-parallel wildcard automaton.

A rule is a glob over a canonical URL. Every glob is cut into positions, each with the characters it accepts and, where a
star follows it, those it may repeat on; the positions of all globs lie one after another in the bits of as many 64-bit words as they
need. Two masks a character (where a position may move on, where it may stay) make one Shift-And step for all globs at once:
states = ((states << 1) & move[c]) | (states & stay[c]), with the bit shifted out of a word carried into the next. A batch of URLs goes character by
character, the longest first, so that rows leave the front as they end; the last few long ones go on as single integers.

Globs: `*` any run without `/`, `**` any run, `?` one character but `/`, `[a-z]` and `[!a-z]` one of a class (negated: but `/`), `\\x` the character x.
A glob fits the whole canonical URL, which is `.` + host + path; so `*.net/**` holds the host net and all below it.

A null url, or one without `://`, has an empty host and path and fits what an empty host fits; each row gives one row, repeated rows and null ids too;
very long URLs cost their length; an empty table gives none; columns other than page_id and url are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CELLS = 1 << 20  # words of state held at once
FEW = 8  # rows that go on as single integers

#: (host, path, verdict): fits the host and its subdomains where the path starts so; the longest rule wins, the earlier of equals.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

#: Words that a host's labels hold where pages are made for search engines, trackers, gambling or adults.
BAD_WORDS = ("adult", "ads", "adserver", "bet", "bets", "betting", "casino", "doubleclick", "escort", "gambling", "lottery", "malware", "phishing", "pills", "poker", "porn", "sex", "spam", "tracker", "viagra", "warez", "xxx")

#: (glob, verdict) for URLs that no rule fits; the longest glob wins, the earlier of equals; none: allow.
GLOBS = [(f"*[.-]{w}[.-]**", "block") for w in BAD_WORDS] + [(g, "block") for g in ("**/wp-admin/**", "**/wp-login.php", "**/cgi-bin/**", "**/xmlrpc.php", "**.[eE][xX][eE]", "**.[aA][pP][kK]")]


def quoted(text: str) -> str:
    return "".join("\\" + c if c in "*?[]\\!" else c for c in text)


def rule_glob(host: str, path: str) -> str:
    return f"*.{quoted(host)}{quoted(path)}**"


@dataclass(frozen=True)
class Chars:
    """A set of characters, or all but those."""

    members: frozenset
    negated: bool = False

    def __contains__(self, c) -> bool:  # None: any character that no glob names
        return (c in self.members) != self.negated


ANY, SEGMENT = Chars(frozenset(), True), Chars(frozenset("/"), True)


def positions(glob: str) -> list[tuple[Chars | None, Chars | None]]:
    """(accepts, repeats on) of each position; the first is the start, which accepts nothing."""
    out: list[list] = [[None, None]]
    k = 0
    while k < len(glob):
        c = glob[k]
        k += 1
        if c == "*":
            both = glob[k : k + 1] == "*"
            k += both
            out[-1][1] = ANY if both or out[-1][1] is ANY else SEGMENT
        elif c == "?":
            out.append([SEGMENT, None])
        elif c == "[" and (end := glob.find("]", k + 1 + (glob[k : k + 1] == "!"))) > 0:  # a class holds one character at least
            negated = glob[k] == "!"
            inside, members = glob[k + negated : end], set()
            k = end + 1
            while inside:
                if len(inside) > 2 and inside[1] == "-":
                    members.update(map(chr, range(ord(inside[0]), ord(inside[2]) + 1)))
                    inside = inside[3:]
                else:
                    members.add(inside[0])
                    inside = inside[1:]
            out.append([Chars(frozenset(members | {"/"} if negated else members), negated), None])
        else:
            if c == "\\" and k < len(glob):
                c, k = glob[k], k + 1
            out.append([Chars(frozenset(c)), None])
    return [tuple(p) for p in out]


class Automaton:
    """The masks of many globs: rows of move and stay are the characters of alphabet and, last, any other."""

    def __init__(self, globs: Sequence[str]):
        parts = [positions(g) for g in globs]
        every = [p for part in parts for p in part]
        named = sorted({c for p in every for s in p if s for c in s.members})
        self.alphabet = np.array([ord(c) for c in named], dtype=np.uint32)
        self.words = max(1, -(-len(every) // 64))
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64) - 1
        starts = np.array([0, *(ends[:-1] + 1)], dtype=np.int64)[: len(parts)]
        self.ends = ends
        self.start = self._packed(np.isin(np.arange(self.words * 64), starts)[None])[0]
        symbols = [*named, None]
        self.move = self._packed(self._bits(symbols, [p[0] for p in every]))
        self.stay = self._packed(self._bits(symbols, [p[1] for p in every]))

    def _bits(self, symbols, sets) -> np.ndarray:
        bits = np.zeros((len(symbols), self.words * 64), dtype=bool)
        known: dict = {}
        for k, s in enumerate(sets):
            if s is not None:
                if s not in known:
                    known[s] = np.array([c in s for c in symbols])
                bits[:, k] = known[s]
        return bits

    @staticmethod
    def _packed(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(np.uint64)

    @cached_property
    def integers(self) -> tuple[list[int], list[int]]:
        whole = lambda rows: [int.from_bytes(r.astype("<u8").tobytes(), "little") for r in rows]
        return whole(self.move), whole(self.stay)

    def states(self, texts: Sequence[str]) -> np.ndarray:
        """The words of all states after each text, one row a text."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
        place = np.minimum(np.searchsorted(self.alphabet, codes), max(len(self.alphabet) - 1, 0))
        symbol = np.where(self.alphabet[place] == codes, place, len(self.alphabet)) if len(self.alphabet) else np.zeros(len(codes), dtype=np.int64)
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        begin, sizes = begin[order], sizes[order]
        held = np.repeat(self.start[None], len(texts), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        t, live = 0, int(np.count_nonzero(sizes))
        while live > FEW:
            now = held[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            c = symbol[begin[:live] + t]
            held[:live] = (moved & self.move[c]) | (now & self.stay[c])
            t += 1
            live = int(np.searchsorted(-sizes, -t, side="left"))  # texts longer than t
        move, stay = self.integers
        for row in range(live):
            now = int.from_bytes(held[row].astype("<u8").tobytes(), "little")
            for c in symbol[begin[row] + t : begin[row] + sizes[row]].tolist():
                now = ((now << 1) & move[c]) | (now & stay[c])
            held[row] = np.frombuffer(now.to_bytes(self.words * 8, "little"), dtype="<u8")
        out = np.empty_like(held)
        out[order] = held
        return out

    def fits(self, texts: Sequence[str]) -> np.ndarray:
        """Whether each text (row) fits each glob (column)."""
        step = max(1, CELLS // max(self.words, len(self.ends)))
        word, bit = self.ends // 64, (self.ends % 64).astype(np.uint64)
        chunks = [(self.states(texts[k : k + step])[:, word] >> bit) & np.uint64(1) for k in range(0, len(texts), step)]
        return np.concatenate(chunks).astype(bool) if chunks else np.zeros((0, len(self.ends)), dtype=bool)


def fitting(canonical: Column, globs: Sequence[str]) -> Column:
    """The places, ascending, of all globs that fit."""
    automaton = Automaton(globs)

    @F.pandas_udf("array<int>")
    def matched(texts: pd.Series) -> pd.Series:
        held = automaton.fits(texts.tolist())
        row, which = np.nonzero(held)
        return pd.Series(np.split(which.astype(np.int32), np.searchsorted(row, np.arange(1, len(held)))), dtype=object) if len(held) else pd.Series([], dtype=object)

    return matched(canonical)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: what follows the first `://`, up to `/`, `?` or `#`, A-Z lower-cased; then up to `?` or `#`."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, globs: Sequence[tuple[str, str]] = GLOBS, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (the longest that fits, or null), pattern (the glob that decided where no rule fits), verdict; one row for each of pages."""
    rules = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    globs = sorted(globs, key=lambda g: -len(g[0]))
    host, path = parts(pages["url"])
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not rules and not globs:
        none = F.lit(None).cast("string")
        return rows.select("*", none.alias("rule"), none.alias("pattern"), F.lit(default).alias("verdict"))
    fits = fitting(F.concat(F.lit("."), "host", "path"), [rule_glob(h, p) for h, p, _ in rules] + [g for g, _ in globs])
    texts = lambda items: F.array(*map(F.lit, items)).cast("array<string>")
    of = lambda items: F.get(texts(items), F.col("winner"))  # noqa: E731  rules come first, so the least place decides
    # the call is not moved below: it is deterministic, but one projection holds it, so that each URL is read once
    found = rows.withColumn("winner", F.array_min(fits))
    return found.select(
        "page_id", "host", "path", F.when(F.col("winner") < len(rules), of([h + p for h, p, _ in rules])).alias("rule"),
        F.get(texts([None] * len(rules) + [g for g, _ in globs]), F.col("winner")).alias("pattern"), F.coalesce(of([v for *_, v in rules] + [v for _, v in globs]), F.lit(default)).alias("verdict"),
    )


def regex(glob: str) -> str:
    """The same glob as a regular expression, for SQL and tests."""

    def char_class(s: Chars) -> str:
        inside = "".join(f"\\x{{{ord(c):x}}}" for c in sorted(s.members))
        return f"[^{inside}]" if s.negated and inside else f"[{inside}]" if inside else r"[\s\S]"

    return "".join((char_class(accepts) if accepts else "") + (char_class(repeats) + "*" if repeats else "") for accepts, repeats in positions(glob))
