import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm import personal_data as pd_
from weft.llm.queries import op4_personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], pd_.KINDS.index(s[2])))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("a.@-+0123459 ()é")), max_size=60))
def test_base_against_patterns(text):
    assert pd_.base_spans(text) == brute(text)


def test_query_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op4_personal_data(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pd_.joined(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pd_.KINDS] == [sum(s[2] == k for s in want) for k in pd_.KINDS]
        assert set(pd_.joined(want).split(",")) <= set(r.spans.split(","))
    assert sum(bool(r.spans) for r in rows) > 10


def test_skip_chain_adds_repeats(spark):
    text = "Call +1 (988) 555-2485 today. " + "filler words here " * 200 + "again 988.555.2485 or by bosbt.42 ; mail bosbt.42@mail8.example.com. Order 77 of 1234567890."
    docs = spark.createDataFrame([(1, text, "k"), (2, "no data at all 988.555.2485", "k"), (3, None, "k"), (4, "", "k"), (None, text, "k"), (1, text, "k")], "doc_id long, text string, base string")
    got = pd_.find(docs).collect()
    by = {r.doc_id: r for r in got}
    said = [(text[s.start : s.end], s.kind) for s in by[1].added]
    assert said == [("988.555.2485", "phone"), ("bosbt.42", "email")]
    assert len(got) == 6 and by[2].added == by[3].base == by[4].added == []
    assert pd_.find(docs.limit(0)).count() == 0
    hidden = {r.doc_id: r for r in pd_.mask(docs.withColumn("n_chars", docs.doc_id)).collect()}
    assert "555" not in hidden[1].text.replace("[PHONE]", "") and "bosbt" not in hidden[1].text and hidden[1].n_chars == len(hidden[1].text)
    assert hidden[2].text == "no data at all 988.555.2485" and hidden[3].text is None


def test_all_repeats_with_weights_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    w = pd_.learn(docs)
    for of in (w, pd_.Weights()):
        for n in (2, 5, 30, 100):
            text = "Call +1 (988) 555-2485 today. " + "then words and again 988.555.2485 ; " * n
            added = pd_.added_spans(text, pd_.base_spans(text), of)
            assert [(text[a:b], k) for a, b, k in added] == [("988.555.2485", "phone")] * n


def test_node_and_skip_weights_do_not_drift_apart(spark):
    text = "Call +1 (988) 555-2485 now. Case 123.456.7890 and 988.555.2485"
    for n in (1, 400, 5000):
        docs = spark.range(n).selectExpr("id doc_id", f"'{text}' text")
        w = pd_.learn(docs, max_sample=n)
        assert [(text[a:b], k) for a, b, k in pd_.added_spans(text, pd_.base_spans(text), w)] == [("988.555.2485", "phone")]


def all_labelings(nodes, w):
    """Marginals by the sum over every labeling of open mentions and hubs."""
    import itertools

    import numpy as np

    L = len(pd_.LABELS)
    keys = sorted({k for n in nodes for k in n.keys if not n.observed})
    many = {k: sum(k in n.keys and not n.observed for n in nodes) for k in keys}
    total = np.zeros((len(nodes), L))
    for y in itertools.product(*([n.label] if n.observed else range(L) for n in nodes)):
        score = sum(w.potential(n.form)[y[k]] for k, n in enumerate(nodes) if not n.observed) + sum(w.chain[a, b] for a, b in zip(y, y[1:]))
        for key in keys:  # hubs share no edge, so each is summed out by itself
            score += np.log(sum(np.exp(sum(w.skip * (y[k] == h) * (1 + many[key] if n.observed else 1) for k, n in enumerate(nodes) if key in n.keys)) for h in range(L)))
        total[np.arange(len(nodes)), y] += np.exp(score)
    return total / total.sum(axis=1, keepdims=True)


def random_field(rng, n, keys, spread):
    import numpy as np

    L = len(pd_.LABELS)
    w = pd_.Weights({f: [rng.uniform(-2, 2) for _ in range(L)] for f in "ab"}, np.array([[rng.uniform(-spread, spread) for _ in range(L)] for _ in range(L)]), rng.uniform(0, 2 * spread))
    return w, [pd_.Node(k, k + 1, rng.choice("abc"), rng.randrange(1, L) if (seen := rng.random() < 0.4) else 0, seen, tuple(rng.sample(keys, rng.randrange(len(keys))))) for k in range(n)]


def test_marginals_against_all_labelings():
    """Exact where chain and skip edges form a tree; within a few hundredths, with the same likeliest labels, on weak loops."""
    import random

    import numpy as np

    rng = random.Random(4)
    for _ in range(15):
        w, nodes = random_field(rng, 5, ["x", "y", "z"], 1.0)
        w.chain[:] = 0  # no chain: hubs with one open mention each are trees
        for k, n in enumerate(nodes):
            n.keys = (f"k{k}",) if not n.observed else tuple(f"k{j}" for j in range(5) if rng.random() < 0.5)
        assert np.allclose(pd_.marginals(nodes, w), all_labelings(nodes, w), atol=1e-4)
    worst = 0.0
    for _ in range(25):
        w, nodes = random_field(rng, 5, ["x", "y"], 0.4)
        got, want = pd_.marginals(nodes, w), all_labelings(nodes, w)
        worst = max(worst, np.abs(got - want).max())
        sure = np.sort(want, axis=1)
        for k in range(5):
            assert sure[k, -1] - sure[k, -2] < 0.05 or got[k].argmax() == want[k].argmax()
    assert worst < 0.05


def test_repeats_without_a_base_span_support_each_other():
    import numpy as np

    text = "see 555-123-4567 then 555 123 4567 or (555) 123.4567 but 77 and 1234"
    nodes = pd_.mentions(text, [])
    assert [n.keys for n in nodes if n.form == "10"] == [("digits:5551234567",)] * 3 and not any(n.keys for n in nodes if n.form != "10")
    phone = pd_.LABELS.index("phone")
    one = np.log([0.35, 0.1, 0.1, 0.1, 0.35])
    w = pd_.Weights({"10": one.tolist()})
    lone = pd_.marginals(pd_.mentions("see 555-123-4567 only", []), w)[:, phone].max()
    w.node["10"][phone] += 0.4  # each is a little likelier a phone; together they are surer
    many = pd_.marginals(nodes, w)
    assert all(p[phone] > 0.6 for n, p in zip(nodes, many) if n.keys) and lone < 0.5
    assert [k for *_, k in pd_.added_spans(text, [], w)] == ["phone"] * 3 and pd_.added_spans(text, [], pd_.Weights()) == []
    assert pd_.added_spans("once 555-123-4567", [], w) == [] and pd_.added_spans("", [], w) == []


def test_training_reaches_the_optimum():
    import numpy as np

    cells = [("11", 5, 5, 4, 4, 30), ("11", 0, 4, 5, 4, 50), ("11", 5, 0, 5, 0, 40), ("2a", 4, 5, 5, 0, 80), ("2a", 5, 5, 1, 1, 9), ("11", 5, 5, 3, 4, 2)]

    def objective(w):
        total, n = 0.0, sum(c[-1] for c in cells)
        chain = np.pad(w.chain, ((0, 1), (0, 1)))
        for form, before, after, hub, label, count in cells:
            s = np.array([w.node[form][y] + chain[before, y] + chain[y, after] + w.skip * (y == hub) for y in range(5)])
            total += count / n * (s[label] - np.log(np.exp(s).sum()))
        far = sum(((np.array(v) - np.log(pd_.FORM_PRIOR)) ** 2).sum() for v in w.node.values()) + (w.chain**2).sum() + (w.skip - pd_.SKIP_PRIOR) ** 2
        return total - pd_.PULL / 2 * far

    w = pd_.trained(cells)
    best = objective(w)
    assert best > objective(pd_.trained(cells, 1)) and pd_.trained([]).skip == pd_.SKIP_PRIOR
    rng = np.random.default_rng(0)
    for _ in range(30):
        moved = pd_.Weights({f: (np.array(v) + rng.normal(0, 0.1, 5)).tolist() for f, v in w.node.items()}, w.chain + rng.normal(0, 0.1, (5, 5)), w.skip + rng.normal(0, 0.1))
        assert objective(moved) < best + 1e-9
    many = pd_.trained([(*c[:-1], c[-1] * 10**7) for c in cells])
    assert np.allclose(many.chain, w.chain) and abs(many.skip - w.skip) < 1e-9


def test_long_runs_take_linear_time():
    import time

    began = time.time()
    mail = " mail bosbt.42@mail8.example.com "
    for text in ("1" * 200_000 + "." + mail, mail + "7 " * 100_000, "+1" + "(" * 100_000 + mail, ("a." * 50_000 + "@") * 2 + mail, mail + "988.555.2485 " * 5_000):
        base = pd_.base_spans(text)
        assert any(k == "email" for *_, k in base)
        pd_.added_spans(text, base, pd_.Weights())
    assert time.time() - began < 20
