from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tests.llm.conftest import EDGES
from vellum.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checksum(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or max(map(int, m[0].split("."))) <= 255, "card": 12 <= len(digits) <= 19 and checksum(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


@given(st.text(alphabet="a1.2@+- 9(b_%é\n0256", max_size=60))
def test_base_spans_match_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_query_matches_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.QUERIES["op9_pii"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        told = [f"{list(PATTERNS)[k]}:{a}:{z}" for a, k, z in brute(docs[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert set(told) <= set(r["spans"].split(",")) | {""}
        assert r["n_email"] == sum(t.startswith("email") for t in told)


def test_edges(spark, edges, nothing):
    found = pii.find_personal_data(edges).collect()
    assert sorted(map(str, (r["doc_id"] for r in found))) == sorted(str(i) for i, _ in EDGES) and not any(r["spans"] for r in found)
    text = "mail a.b@c.de and 10.0.0.1"
    tied = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (3, "")], "doc_id long, text string")
    told = sorted(str((r["doc_id"], [(x["kind"], x["start"], x["end"]) for x in r["spans"]])) for r in pii.find_personal_data(tied).collect())
    want = [("email", 5, 13), ("ip", 18, 26)]
    assert told == sorted(map(str, [(1, want), (1, want), (None, want), (2, []), (3, [])]))
    assert pii.find_personal_data(nothing).collect() == []


def test_long_texts_take_linear_time():
    for text in ("a" * 1_000_000 + " 1", "1" * 1_000_000, "+1" + "(" * 1_000_000, "a@" * 300_000, "1." * 300_000, "10.0.0.1 " * 50_000, "+49 170 5551234 x " * 20_000, "1 2 3 " * 100_000):
        begin = time.time()
        base = pii.base_spans(text)
        field = pii.build([text], [base])
        assert len(field.doc) <= 200_000 and time.time() - begin < 12, (text[:20], time.time() - begin)


def mentions(rng):
    """A document with a number that the patterns find, another mention of it that they don't, and numbers that are nobody's."""
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    kind = rng.randrange(4)
    if kind == 0:
        n = "170" + digits(7)
        first, again = f"+49 {n[:3]} {n[3:]}", rng.choice([f"0{n[:3]} {n[3:]}", f"0{n[:3]}-{n[3:6]}-{n[6:]}", n, f"({n[:3]}) {n[3:6]} {n[6:]}", f"0049 {n}"])
    elif kind == 1:
        n = digits(15)
        n += next(d for d in "0123456789" if pii.luhn(n + d))
        at = rng.randrange(16)
        wrong = n[:at] + str((int(n[at]) + 1) % 10) + n[at + 1 :]
        first, again = " ".join(n[i : i + 4] for i in range(0, 16, 4)), rng.choice([".".join(n[i : i + 4] for i in range(0, 16, 4)), wrong, "/".join(n[i : i + 4] for i in range(0, 16, 4))])
    elif kind == 2:
        parts = [str(rng.randint(100, 255)) for _ in range(4)]
        first, again = ".".join(parts), rng.choice(["-".join(parts), "_".join(parts), ",".join(parts)])
    else:
        first = f"user{digits(3)}@example.org"
        again = first.replace(".", "_")
    free = [f"order {digits(8)}", f"in {rng.randint(1900, 2030)}", f"{digits(2)},{digits(3)} pieces", f"version {digits(1)}.{digits(2)}", f"case {digits(10)}"]
    same = first.replace("+49 ", "+49 (0)") if kind == 0 else first.replace(" ", "-") if kind == 1 else first
    twice = f" or {same}" if rng.random() < 0.3 else ""  # the patterns find this one too
    return f"Please call or write to {first}{twice}, {rng.choice(free)} was sent.", f"Then {rng.choice(free)} and later", again, f"was given. {rng.choice(free)}."


def test_planted_mentions_are_found_and_other_numbers_left(spark):
    rng = random.Random(21)
    rows, want = [], {}
    for i in range(3000):
        head, middle, again, tail = mentions(rng)
        text = f"{head} {middle} {again} {tail}"
        rows.append((i, text))
        want[i] = (text.rindex(again), text.rindex(again) + len(again))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    plain = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id + 100000 AS doc_id", "text")
    found = pii.find_personal_data(docs.unionByName(plain)).filter("doc_id < 100000").collect()
    caught = alarms = 0
    for r in found:
        a, z = want[r["doc_id"]]
        added = [(x["start"], x["end"]) for x in r["spans"] if not x["base"]]
        caught += any(s <= a + 1 and e >= z - 1 for s, e in added)
        alarms += any(e <= a or s >= z for s, e in added)
    assert caught >= 0.9 * len(rows) and alarms <= 0.02 * len(rows), (caught, alarms)


def test_nodes_are_numbers_with_those_after_them_and_tokens():
    told = lambda t: [t[a:z] for a, z in pii.nodes(t)]
    assert told("call +49 (170) 555-1234, or x9 a@b 12:30 no") == ["+49 (170) 555-1234", "x9", "a@b", "12:30"]
    assert told('"3,5" 10 20 30. 40 (2)') == ["3,5", "10 20 30", "40 (2)"]
    assert told("") == told("abc def") == []


def test_alike_nodes_are_linked():
    text = "+49 170 5551234 x 0170-5551234 y 1705551235 z 170 5551234"
    f = pii.build([text], [[]])
    pairs = {(text[f.start[a] : f.end[a]], text[f.start[b] : f.end[b]]): int(k) for (a, b), k in zip(f.skip.tolist(), f.kind.tolist(), strict=True)}
    assert pairs[("+49 170 5551234", "0170-5551234")] == pii.TAILS and pairs[("0170-5551234", "170 5551234")] == pii.TAILS
    assert pairs[("1705551235", "170 5551234")] == pii.NEAR
    assert pii.build(["10 apples 10"], [[]]).skip.tolist() == []


def joint(field, model):
    """Marginals by brute force, over all labellings."""
    n, e = len(field.doc), [*((a, b, model.chain) for a, b in field.chain), *((a, b, model.same[k] * np.eye(pii.K)) for (a, b), k in zip(field.skip, field.kind, strict=True))]
    p = np.zeros((pii.K,) * n)
    for at in np.ndindex(*p.shape):
        if all(field.label[i] in (0, at[i]) for i in range(n)):
            p[at] = np.exp(sum(0 if field.label[i] else model.node[field.shape[i], at[i]] for i in range(n)) + sum(t[at[a], at[b]] for a, b, t in e))
    return [p.sum(tuple(j for j in range(n) if j != i)) / p.sum() for i in range(n)]


def test_skip_messages_match_brute_force():
    rng = np.random.default_rng(9)
    ints = lambda x: np.array(x, np.int64).reshape(-1, 2)
    for chain, skip, close in (([], [[0, 1], [1, 2], [1, 3]], 1e-6), ([[0, 1], [2, 3]], [[1, 2]], 1e-6), ([[0, 1], [1, 2], [2, 3]], [[0, 2], [1, 3]], 0.05)):
        model = pii.Model(rng.uniform(-4, 0, (pii.N_SHAPES, pii.K)), rng.uniform(-0.5, 0.5, (pii.K, pii.K)), rng.uniform(0, 3, 3))
        label = np.array([0, 0, 0, 2])
        field = pii.Field(np.zeros(4, int), np.arange(4), np.arange(4), np.arange(4), label, ints(chain), ints(skip), np.arange(len(skip)) % 3)
        got = pii.posterior(field, model, rounds=200)
        assert np.abs(got - np.array(joint(field, model))).max() < close


def test_belief_propagation_is_exact_on_a_chain():
    rng = np.random.default_rng(2)
    model = pii.Model(np.log(rng.dirichlet(np.ones(pii.K), pii.N_SHAPES)), rng.normal(size=(pii.K, pii.K)), np.ones(3))
    n = 4
    empty = np.zeros((0, 2), np.int64)
    field = pii.Field(np.zeros(n, int), np.arange(n), np.arange(n), np.arange(n), np.zeros(n, int), np.array([[0, 1], [1, 2], [2, 3]]), empty, np.zeros(0, int))
    got = pii.posterior(field, model, rounds=80)
    assert np.allclose(got, joint(field, model), atol=1e-6)
