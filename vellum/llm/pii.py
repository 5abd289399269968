"""Personal data: exact patterns, and a skip-chain conditional random field that carries their labels to like tokens.

A document's nodes are its tokens that hold a digit or an at sign; numbers that follow one another are one node, as they are
parts of one number more often than not. Neighbours in the text share a chain potential. Equal and similar nodes share a skip
potential, however far apart: each node is linked to the last one before it with the same letters and digits, to the last with
the same ``TAIL`` last digits (other separators, prefixes or none), and to the last that one character's change, loss or
addition makes equal. Keys under ``LEAST`` characters link nothing. Loopy belief propagation runs over all documents of a batch
at once.

Potentials are learnt from counts over the whole table. The patterns' finds are labels. A node that none covers counts as no
personal data, unless it is linked to one that is covered: such a node's label is unknown, and it is left out of the counts, so
that the field isn't taught to keep silent just where it is needed. Skip links between nodes that are both covered say how
often linked labels agree. What no pattern covers is reported when its posterior says so.

A null text counts as empty and has no spans. Repeated rows and tied ids are each judged alone. An empty table gives an empty
result. Other columns are ignored. Texts are read whole, in time linear in their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# no match can begin within a run of digits if none begins at its start
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# begins at a run's start only and never gives back what it has passed, so that each run is read once
_NODE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_NEXT = re.compile(r"(?<=[0-9)])\x20[().-]*+[0-9][().0-9-]*+(?![^\x20\x09-\x0D,;:!?])")
_NUMBER = re.compile(r"[+(]*[0-9][().0-9-]*")
_DIGIT = re.compile(r"[0-9]")
_KEY = re.compile(r"[^0-9A-Za-z]+")
_EDGES = "\"'[]{}<>,;:.!?#*$%&|"
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
#: Characters in a key that links; digits in a tail; the longest key that is linked to nearly equal ones.
LEAST, TAIL, LONGEST = 6, 7, 40
EQUAL, TAILS, NEAR = range(3)
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the patterns' finds, by start and then kind."""
    found: list[Span] = []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or "0") <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                    found.append((m.start(), 3, m.end()))
    found.sort()
    return found


@dataclass
class Field:
    """The nodes of some documents' fields and the edges among them."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    label: np.ndarray  # 0 none, else 1 + the kind of the base span that covers it
    chain: np.ndarray  # pairs of nodes
    skip: np.ndarray
    kind: np.ndarray  # of each skip edge: EQUAL, TAILS or NEAR


def _shape(token: str) -> int:
    digits = sum(map(token.count, "0123456789"))
    letters = sum(c.isalpha() for c in token)
    size = 0 if not digits else 1 if digits < 3 else 2 if digits < 7 else 3 if digits < 12 else 4 if digits < 20 else 5
    return (((size * 3 + min(2, token.count("@"))) * 5 + min(4, token.count("."))) * 2 + (token[0] == "+")) * 3 + min(2, letters)


N_SHAPES = 6 * 3 * 5 * 2 * 3


def nodes(text: str) -> Iterator[tuple[int, int]]:
    """Where the text's nodes begin and end."""
    at = 0
    while m := _NODE.search(text, at):
        a, z = m.span()
        at = z
        if _NUMBER.fullmatch(text, a, z):  # a number goes on with the numbers after it
            while n := _NEXT.match(text, at):
                at = z = n.end()
        token = text[a:z]
        a += len(token) - len(token.lstrip(_EDGES))
        z = a + len(token.strip(_EDGES))
        if z > a:
            yield a, z


def _links(key: str) -> list[tuple[int, object]]:
    """What a node with the key is linked by: nodes that have one of these in common are alike."""
    if len(key) < LEAST:
        return []
    links: list[tuple[int, object]] = [(EQUAL, key)]
    if key.isdigit() and len(key) >= TAIL:
        links.append((TAILS, key[-TAIL:]))
    if len(key) <= LONGEST:
        links.append((NEAR, key))
        links += [(NEAR, key[:i] + key[i + 1 :]) for i in range(len(key)) if not i or key[i] != key[i - 1]]
    return links


def build(texts: list[str], spans: list[list[Span]]) -> Field:
    doc, start, end, shape, label, chain, skip, kinds = [], [], [], [], [], [], [], []
    for d, (text, base) in enumerate(zip(texts, spans, strict=True)):
        if "@" not in text and not _DIGIT.search(text):
            continue
        last: dict[tuple[int, object], int] = {}
        first, covers = len(doc), iter(sorted(base))
        open_spans: list[Span] = []
        pending = next(covers, None)
        for a, z in nodes(text):
            token, i = text[a:z], len(doc)
            while pending and pending[0] < z:
                open_spans.append(pending)
                pending = next(covers, None)
            open_spans = [s for s in open_spans if s[2] > a]
            doc.append(d)
            start.append(a)
            end.append(z)
            shape.append(_shape(token))
            label.append(1 + open_spans[0][1] if open_spans else 0)
            if i > first:
                chain.append((i - 1, i))
            linked: set[int] = set()
            for link in _links(_KEY.sub("", token).lower()):
                j = last.get(link)
                if j is not None and j != i and j not in linked:
                    linked.add(j)
                    skip.append((j, i))
                    kinds.append(link[0])
                last[link] = i
    ints = lambda x: np.array(x, np.int64)
    return Field(ints(doc), ints(start), ints(end), ints(shape), ints(label), ints(chain).reshape(-1, 2), ints(skip).reshape(-1, 2), ints(kinds))


K = 1 + len(KINDS)
N_CHAIN, N_SKIP = K * K, 3 * 2


#: How far a token's shape can speak against a label, and the weight of all links' agreement in that of each kind.
ALONE, LEAN = 2.0, 20.0


@dataclass(frozen=True)
class Model:
    """Log potentials: of a shape's labels, of neighbours' labels, and of equal labels at both ends of each kind of skip edge.
    A shape never speaks for personal data, so that no token is reported which isn't like another one."""

    node: np.ndarray
    chain: np.ndarray
    same: np.ndarray


def counted(f: Field) -> np.ndarray:
    """N_SHAPES * K counts of shape and label, K * K of neighbouring labels, and for each kind of skip edge between covered nodes
    how many disagree and agree. Nodes whose label is unknown aren't counted."""
    covered = f.label > 0
    unknown = np.zeros(len(f.doc), bool)
    if len(f.skip):
        a, b = f.skip.T
        unknown[a[~covered[a] & covered[b]]] = True
        unknown[b[~covered[b] & covered[a]]] = True
    total = np.zeros(N_SHAPES * K + N_CHAIN + N_SKIP, np.int64)
    np.add.at(total, (f.shape * K + f.label)[~unknown], 1)
    a, b = f.chain.T
    sure = ~unknown[a] & ~unknown[b]
    np.add.at(total, N_SHAPES * K + (f.label[a] * K + f.label[b])[sure], 1)
    a, b = f.skip.T
    both = covered[a] & covered[b]
    np.add.at(total, N_SHAPES * K + N_CHAIN + (f.kind * 2 + (f.label[a] == f.label[b]))[both], 1)
    return total


def fit(counts: np.ndarray) -> Model:
    """The potentials from the sums of ``counted``."""
    node = np.log(counts[: N_SHAPES * K].reshape(N_SHAPES, K) + np.array([1.0, *[0.1] * (K - 1)]))
    pairs = counts[N_SHAPES * K : N_SHAPES * K + N_CHAIN].reshape(K, K) + 1.0
    share = pairs.sum(1) / pairs.sum()
    chain = np.log(pairs / pairs.sum()) - np.log(share[:, None] * share[None, :])
    links = counts[N_SHAPES * K + N_CHAIN :].reshape(-1, 2)
    whole = links.sum(0) + np.array([0.1, 4.9])  # each kind of link leans towards what all kinds say, as so many links would
    differ, agree = (links + LEAN * whole / whole.sum()).T
    # alike by chance, two nodes have equal labels once in K
    return Model(np.clip(node - node[:, :1], -ALONE, 0), 0.25 * np.clip(chain, -2, 2), np.clip(np.log((K - 1) * agree / differ), 0, 9))


def posterior(field: Field, model: Model, rounds: int = 10) -> np.ndarray:
    """Marginals by loopy belief propagation; nodes that a pattern covers are clamped to its label."""
    n = len(field.doc)
    node = model.node[field.shape].copy()
    known = np.flatnonzero(field.label)
    node[known] = -50.0
    node[known, field.label[known]] = 0.0
    pairs = np.concatenate((field.chain, field.skip))
    a, b = np.concatenate((pairs, pairs[:, ::-1])).T if len(pairs) else (np.zeros(0, int), np.zeros(0, int))
    m, c = len(pairs), len(field.chain)
    table = np.empty((2 * m, K, K))
    table[:c], table[m : m + c] = model.chain, model.chain.T
    table[c:m] = table[m + c :] = model.same[field.kind][:, None, None] * np.eye(K)
    back = np.concatenate((np.arange(m) + m, np.arange(m)))
    message = np.zeros((2 * m, K))

    def belief() -> np.ndarray:
        total = node.copy()
        np.add.at(total, b, message)
        return total

    for _ in range(rounds if m else 0):
        out = (belief()[a] - message[back])[:, :, None] + table
        top = out.max(1)
        new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
        message = 0.5 * message + 0.5 * (new - new.max(1, keepdims=True))
    p = belief()
    p = np.exp(p - p.max(1, keepdims=True)) if n else p
    return p / p.sum(1, keepdims=True)


def learn(docs: DataFrame, text: str = "text") -> Model:
    """Counts labels by shape, neighbours and skip edges over the whole table: a fixed number of sums."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_SHAPES * K + N_CHAIN + N_SKIP, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            total += counted(build(texts, [base_spans(t) for t in texts]))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    counts = np.zeros(N_SHAPES * K + N_CHAIN + N_SKIP)
    for at, n in docs.select(F.col(text).cast("string")).mapInArrow(tally, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        counts[at] = n
    return fit(counts)


def find_personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text", sure: float = 0.8) -> DataFrame:
    """One row per row of docs: id and spans, an array of (kind, start, end, base, p) in code points, by start and then kind."""
    model = learn(docs, text)
    span = "array<struct<kind:string,start:int,end:int,base:boolean,p:double>>"
    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), T.StructField("spans", T._parse_datatype_string(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            spans = [[(s, k, e, True, 1.0) for s, k, e in b] for b in base]
            field = build(texts, base)
            p = posterior(field, model)
            kind = p.argmax(1) if len(p) else np.zeros(0, int)
            for i in np.flatnonzero((field.label == 0) & (kind > 0) & (p.max(1, initial=0) >= sure)).tolist():
                spans[field.doc[i]].append((int(field.start[i]), int(kind[i]) - 1, int(field.end[i]), False, float(p[i].max())))
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "base": b, "p": q} for s, k, e, b, q in sorted(x)] for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPANS)], ["id", "spans"])

    return docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("p", pa.float64())]))
