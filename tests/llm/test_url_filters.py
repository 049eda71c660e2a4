import random
import re

import numpy as np
import pytest

from weft.llm import url_filters as u
from weft.llm.queries import op11_url_filters


def fits(parts, text):
    """A glob by its definition: the sets of places that a text may be at."""
    at = {0}
    for c in [*text, None]:
        if c is None:
            return len(parts) - 1 in at
        at = {p + 1 for p in at if p + 1 < len(parts) and c in parts[p + 1][0]} | {p for p in at if parts[p][1] is not None and c in parts[p][1]}


def judged(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    raw = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(raw):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
    own = [(h + p, v) for h, p, v in u.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(own, key=lambda r: len(r[0])) if own else None
    if rule:
        return host, path, *rule
    spam = set(re.split("[.-]", host)[:-1]) & set(u.BAD_WORDS) or re.search(r"/wp-admin/|/wp-login\.php$|/cgi-bin/|/xmlrpc\.php$|\.(?i:exe|apk)$", path)
    return host, path, None, "block" if spam else "allow"


ODD = ["http://A.Org", "http://a.org/", "http://aorg/", "http://org/x", "http://example.org/es/1", "http://m.example.org/en/17?x", "http://x.com/de/#a", "http://x.com/de", "http://com/fr/é", "http://é.COM/fr/x", "http://a.net/x.org/", "http://a.net?q=b.org/",
       "no scheme", "", None, "://", ":///org/", "http://www.free-bets.net/en/1", "http://a.net/wp-admin/x", "http://a.net/b/x.EXE", "http://a.net/x.exe?y", "http://a.net/\n/cgi-bin/x", "x://y://casino.net/", "http://casino.net", "http://a*b.net/[x]", "http://ÀÈ.net/😀", "http://a.net/" + "y" * 30000 + "/wp-login.php"]


def test_query_against_a_loop(spark, sf_dir):
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in op11_url_filters(spark, sf_dir).collect()]
    assert sorted(got) == sorted((i, *judged(x)) for i, x in pages)
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_odd_urls_repeats_and_clashing_columns(spark):
    rows = [(k if k % 5 else None, x, "x", "y") for k, x in enumerate(ODD + ODD[:9])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, winner string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in u.judge(pages).collect()]
    assert sorted(got, key=str) == sorted(((i, *judged(x)) for i, x, *_ in rows), key=str)
    assert u.judge(pages.limit(0)).collect() == []
    plain = u.judge(pages, [], [], "block").collect()
    assert len(plain) == len(rows) and {(r.rule, r.pattern, r.verdict) for r in plain} == {(None, None, "block")}


def test_longest_wins_and_the_earlier_of_equals(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/x/y")], "page_id long, url string")
    first = u.judge(pages, [("c", "/x/y", "allow"), ("b.c", "/x", "block"), ("c", "/", "block"), ("b.c", "/x", "allow")], []).first()
    assert (first.rule, first.verdict) == ("c/x/y", "allow")
    assert u.judge(pages, [], [("**/y", "block"), ("**/x/y", "allow")]).first().pattern == "**/x/y"


@pytest.mark.parametrize("seed", range(6))
def test_automaton_against_the_definition(seed):
    rng = random.Random(seed)
    piece = lambda: rng.choice(["a", "b", "é", "/", "?", "*", "**", "[ab]", "[!a]", "[a-c😀]", "\\*", ".", "[", "]"])
    globs = ["".join(piece() for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["", "**", "a" * 70 + "*b"]
    texts = ["".join(rng.choice("ab/.*é😀c[]") for _ in range(rng.choice([0, 1, 3, 8, 20]))) for _ in range(120)] + ["a" * 90 + "b", "a" * 300]
    machine = u.Automaton(globs)
    assert machine.words > 3
    want = np.array([[fits(u.positions(g), t) for g in globs] for t in texts])
    assert np.array_equal(machine.fits(texts), want)
    assert np.array_equal(np.concatenate([machine.fits([t]) for t in texts]), want)  # single rows go as integers
    for g in globs:  # the same as a regular expression, where Python can read it
        said = re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), u.regex(g))
        assert [bool(re.fullmatch(said, t)) for t in texts] == want[:, globs.index(g)].tolist()
