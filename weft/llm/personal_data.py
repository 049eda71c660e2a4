"""Personal data by a skip-chain conditional random field over the mentions of each document.

Base spans (e-mail, IP, card, phone) come from patterns and checks, leftmost and non-overlapping within a kind.
They are observed nodes of the field. Further nodes are mentions outside them: digit groups and words.
Neighbouring mentions share chain potentials. Distant mentions of one normal form (the same digits in other separators, a phone's
national number, an address's local part), wherever they stand, share a hub: a latent label, to which each of them has a skip edge that rewards
agreement, so edges grow with the mentions, not with their pairs. A form has a hub if a base span or at least two mentions of REPEATED
digits or more bear it. A base span's edge counts once for itself and once for each open mention of the form, so that repeats, which know
nothing by themselves, do not outvote it. Chains and hubs form loops; damped sum-product messages run along all
edges both ways until they settle (in ROUNDS at most). An open mention with a hub whose likeliest label is an entity becomes an added span.

Training: node, chain and skip weights maximise the mean log pseudo-likelihood of the known labels (base spans, and
mentions like none of them, which are other) given neighbours and their form's hub, which stands at the likeliest label that the other base spans give it, less PULL times the squared distance from
the prior weights; so weights keep their scale at any sample size: that base patterns never match a form is no proof that it holds no
entity. Known mentions of at most about MAX_SAMPLE documents (by hash of the id) are counted in Spark by form, neighbours, hub and label, a closed set of cells, and
the gradient runs over the cells; everything else reads all rows. Null and empty texts give no spans;
repeated rows give equal rows. Places are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
MAX_SAMPLE = 20_000
NONE = len(LABELS)  # no neighbour, or one of unknown label; no other base span of the form
SKIP_PRIOR = math.log(800)
FORM_PRIOR = (0.6, 0.1, 0.1, 0.1, 0.1)
PULL, STEPS = 0.02, 400
REPEATED = 7
ROUNDS, DAMPING, SETTLED = 200, 0.5, 1e-6

EMAIL_END = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NUMBER = re.compile(r"\+?\(?[0-9](?:[ ().\-/_]{0,2}[0-9])+")
NAME, LETTER = re.compile(r"[A-Za-z0-9._%+-]+"), re.compile("[A-Za-z]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Found from each @: the longest run before it, as far as the last match, and the dotted name after it."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_CHARS:
            start -= 1
        if start < at and (m := EMAIL_END.match(text, at)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    if not text:
        return []
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [(*m.span(), "ip") for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.groups())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


@dataclass
class Node:
    start: int
    end: int
    form: str  # the shape its potential depends on
    label: int  # of an observed node, else 0
    observed: bool
    keys: tuple[str, ...] = ()


def mentions(text: str, base: list[tuple[int, int, str]]) -> list[Node]:
    """Base spans and the mentions outside them, in text order, with the normal forms whose hubs they have edges to."""
    nodes, wanted = [], set()
    for a, b, kind in base:
        keys = normal_forms(text[a:b], kind)
        wanted.update(keys)
        nodes.append(Node(a, b, shape(text[a:b]), LABELS.index(kind), True, keys))
    covered = np.zeros(len(text) + 1, bool)
    for a, b, _ in base:
        covered[a:b] = True
    again: Counter = Counter()
    for pattern in (NUMBER, NAME):
        for m in pattern.finditer(text):
            a, b = m.span()
            if (pattern is NUMBER or LETTER.search(m[0])) and not covered[a:b].any():
                keys = normal_forms(m[0], None)
                again.update(keys if pattern is NUMBER else ())
                nodes.append(Node(a, b, shape(m[0]), 0, False, keys))
    wanted.update(k for k, n in again.items() if n > 1 and len(k) >= len("digits:") + REPEATED)
    for n in nodes:
        n.keys = tuple(k for k in n.keys if k in wanted)
    return sorted(nodes, key=lambda n: (n.start, n.end))


def repeats(text: str) -> bool:
    """Whether some digits, REPEATED or more, are written twice."""
    seen = set()
    for m in NUMBER.finditer(text):
        digits = "".join(DIGIT.findall(m[0]))
        if len(digits) >= REPEATED:
            if digits in seen:
                return True
            seen.add(digits)
    return False


def normal_forms(said: str, kind: str | None) -> tuple[str, ...]:
    """Forms two mentions must share to be linked; of one that is no base span, all it may stand for."""
    digits = "".join(DIGIT.findall(said))
    if kind == "email":
        local, _, host = said.lower().partition("@")
        return (f"name:{local}",) if len(local) >= 5 else ()
    if kind == "phone":
        return (f"digits:{digits}", f"digits:{digits[-10:]}") if len(digits) > 10 else (f"digits:{digits}",)
    if kind is not None:
        return (f"digits:{digits}",)
    if re.search("[A-Za-z]", said):
        return (f"name:{said.strip('.').lower()}",)
    return (f"digits:{digits}",) if len(digits) >= 4 else ()


def shape(said: str) -> str:
    """A closed set of forms: the number of digits up to 20, whether there are letters, whether there is an @; no separators, as they vary."""
    return f"{min(len(DIGIT.findall(said)), 20)}{'a' if LETTER.search(said) else ''}{'@' if '@' in said else ''}"


@dataclass
class Weights:
    node: dict[str, list[float]] = field(default_factory=dict)
    chain: np.ndarray = field(default_factory=lambda: np.zeros((len(LABELS), len(LABELS))))
    skip: float = SKIP_PRIOR

    def potential(self, form: str) -> np.ndarray:
        return np.array(self.node[form]) if form in self.node else np.log(np.array(FORM_PRIOR))


def trained(cells: list[tuple[str, int, int, int, int, int]], steps: int = STEPS) -> Weights:
    """Weights of (form, label before, label after, hub's label, label, count) cells by accelerated gradient ascent."""
    if not cells:
        return Weights()
    forms = sorted({c[0] for c in cells})
    form = np.array([forms.index(c[0]) for c in cells])
    before, after, hub, label, count = np.array([c[1:] for c in cells]).T
    share, n = count / count.sum(), len(LABELS)
    prior = (np.tile(np.log(np.array(FORM_PRIOR)), (len(forms), 1)), np.zeros((n, n)), np.array(SKIP_PRIOR))
    wide = lambda chain: np.pad(chain, ((0, 1), (0, 1)))
    target = np.eye(n)[label]
    now, ahead, momentum = prior, prior, 1.0
    for _ in range(steps):
        node, chain, skip = ahead
        score = node[form] + wide(chain)[before, :n] + wide(chain)[:n, after].T + skip * np.eye(n + 1)[hub, :n]
        p = np.exp(score - score.max(axis=1, keepdims=True))
        left = share[:, None] * (target - p / p.sum(axis=1, keepdims=True))
        up = [np.zeros_like(node), np.zeros((n + 1, n + 1)), np.sum(left * np.eye(n + 1)[hub, :n])]
        np.add.at(up[0], form, left)
        for k in range(n):
            np.add.at(up[1], (before, k), left[:, k])
            np.add.at(up[1], (k, after), left[:, k])
        up[1] = up[1][:n, :n]
        new = tuple(w + (g - PULL * (w - w0)) / 2.5 for w, g, w0 in zip(ahead, up, prior, strict=True))
        later = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        ahead = tuple(b + (momentum - 1) / later * (b - a) for a, b in zip(now, new, strict=True))
        now, momentum = new, later
    node, chain, skip = now
    return Weights({f: node[k].tolist() for k, f in enumerate(forms)}, chain, float(skip))


def hubs(nodes: list[Node]) -> dict[str, list[int]]:
    """The labels of each form's base spans, in text order."""
    out = defaultdict(list)
    for n in nodes:
        if n.observed:
            for key in n.keys:
                out[key].append(n.label)
    return out


def agreeing(sent: np.ndarray, skip: float) -> np.ndarray:
    """What messages (rows of log weights of labels) become across an edge that rewards agreement by skip."""
    top = sent.max(axis=1, keepdims=True)
    new = np.log(np.exp(sent - top).sum(axis=1, keepdims=True) + np.exp(sent - top) * (math.exp(skip) - 1))
    return new - new.max(axis=1, keepdims=True)


def across(sent: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """What messages become across chain edges with the log potentials pair."""
    new = sent[:, :, None] + pair
    top = new.max(axis=1, keepdims=True)
    new = np.log(np.exp(new - top).sum(axis=1)) + top[:, 0]
    return new - new.max(axis=1, keepdims=True)


def marginals(nodes: list[Node], w: Weights) -> np.ndarray:
    """Label probabilities by loopy sum-product in the log domain: chain and skip messages in turn, skip messages damped, until none changes."""
    n, own = len(LABELS), np.arange(len(LABELS))
    unary = np.array([w.potential(x.form) if not x.observed else np.where(own == x.label, 0.0, -1e3) for x in nodes])
    edges = [(k, key) for k, x in enumerate(nodes) if not x.observed for key in x.keys]
    keys = {key: k for k, key in enumerate(dict.fromkeys(key for _, key in edges))}
    node, hub = (np.array(c, dtype=np.int64) for c in ([k for k, _ in edges], [keys[key] for _, key in edges]))
    held = np.zeros((len(keys), n))  # what base spans say to the hubs
    open_ = np.bincount(hub, minlength=len(keys))
    for key, labels in hubs(nodes).items():
        if key in keys:
            held[keys[key]] += w.skip * (1 + open_[keys[key]]) * np.bincount(labels, minlength=n)
    to_hub, to_node = np.zeros((len(edges), n)), np.zeros((len(edges), n))
    right, left = np.zeros_like(unary), np.zeros_like(unary)  # from the node before, from the node after

    def gathered(at, rows, messages):
        out = np.zeros((rows, n))
        np.add.at(out, at, messages)
        return out

    for _ in range(ROUNDS):
        local = unary + gathered(node, len(nodes), to_node)
        to_right, to_left = across((local + right)[:-1], w.chain), across((local + left)[1:], w.chain.T)
        change = max(np.abs(to_right - right[1:]).max(initial=0), np.abs(to_left - left[:-1]).max(initial=0))
        right[1:], left[:-1] = to_right, to_left
        if edges:
            belief = local + right + left
            up = DAMPING * to_hub + (1 - DAMPING) * agreeing(belief[node] - to_node, w.skip)
            whole = held + gathered(hub, len(keys), up)
            down = DAMPING * to_node + (1 - DAMPING) * agreeing(whole[hub] - up, w.skip)
            change = max(change, np.abs(up - to_hub).max(), np.abs(down - to_node).max())
            to_hub, to_node = up, down
        if change < SETTLED:
            break
    belief = unary + gathered(node, len(nodes), to_node) + right + left
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[tuple[int, int, str]], w: Weights) -> list[tuple[int, int, str]]:
    if not base and not (text and DIGIT.search(text) and repeats(text)):
        return []
    nodes = mentions(text, base)
    if not any(n.keys and not n.observed for n in nodes):
        return []  # no open mention is like a base span or another
    p = marginals(nodes, w)
    best = p.argmax(axis=1)
    return [(n.start, n.end, LABELS[k]) for n, k in zip(nodes, best, strict=True) if not n.observed and n.keys and k]


def known_cells(nodes: list[Node]) -> Counter:
    """(form, label before, label after, hub's label, label) of every mention whose label is known, with how often each occurs."""
    each, seen = hubs(nodes), Counter()
    known = [n.label if n.observed or not any(key in each for key in n.keys) else NONE for n in nodes]
    for k, n in enumerate(nodes):
        if known[k] != NONE:
            others = Counter(x for key in n.keys for x in each.get(key, ()))
            others.subtract(Counter({n.label: len(n.keys)}) if n.observed else {})
            hub = max((x for x, many in others.items() if many > 0), key=lambda x: (others[x], -x), default=NONE)
            seen[n.form, known[k - 1] if k else NONE, known[k + 1] if k + 1 < len(nodes) else NONE, hub, n.label] += 1
    return seen


def learn(docs: DataFrame, max_sample: int = MAX_SAMPLE) -> Weights:
    """Weights from a bounded sample of documents, labelled by the base patterns."""
    n = docs.count()
    text = F.col("text").cast("string").alias("text")
    share = max_sample / n if n else 1.0
    sample = docs.select(text) if share >= 1 else docs.where(F.xxhash64("doc_id", "text") < F.lit(int(share * 2**64) - 2**63)).select(text)
    names = ("form", "before", "after", "hub", "label", "n")

    def count(batches):
        for batch in batches:
            seen = Counter()
            for t in batch.column(0).to_pylist():
                if base := base_spans(t):
                    seen.update(known_cells(mentions(t, base)))
            rows = list(zip(*((*k, n) for k, n in seen.items()), strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), *(pa.array(c, pa.int64()) for c in rows[1:])], names=names)

    cells = sample.mapInArrow(count, "form string, before long, after long, hub long, label long, n long").groupBy(*names[:-1]).agg(F.sum("n").alias("n"))
    return trained(sorted(map(tuple, cells.collect())))


SCHEMA = "base array<struct<start:int,end:int,kind:string>>, added array<struct<start:int,end:int,kind:string>>"


def find(docs: DataFrame, weights: Weights | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with the base and added spans of each row's text."""
    w = weights or learn(docs)
    given = docs.select(*keep, docs[text].cast("string").alias("text_to_search"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    names = [*given.columns[:-1], "base", "added"]

    def run(batches):
        for batch in batches:
            base, added = [], []
            for t in batch.column(len(keep)).to_pylist():
                found = base_spans(t)
                base.append([{"start": a, "end": b, "kind": k} for a, b, k in found])
                added.append([{"start": a, "end": b, "kind": k} for a, b, k in added_spans(t, found, w)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(base, kind), pa.array(added, kind)], names=names)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{kept}, {SCHEMA}")


def digests(found: DataFrame) -> DataFrame:
    """The digest columns of find()'s rows: counts and hash of the base spans, and all spans as text."""
    order = F.create_map(*[x for k, name in enumerate(KINDS) for x in (F.lit(name), F.lit(k))])
    said = lambda spans: F.array_join(F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s.start, order[s.kind], s.end, s.kind.alias("kind")))), lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(said(F.col("base")), 256).alias("base_sha256"),
        said(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def masked(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """text with each span, or group of overlapping spans, replaced by the [KIND] of the first."""
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """docs with the text of every span replaced by its kind, and n_chars set to the new length."""
    w = weights or learn(docs)
    kind = docs.schema["text"].dataType

    @F.pandas_udf(kind)
    def hide(texts):
        return texts.map(lambda t: None if t is None else masked(t, (b := base_spans(t)) + added_spans(t, b, w)))

    new = docs.withColumn("text", hide("text"))
    return new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else new
