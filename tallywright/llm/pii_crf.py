"""Personal data by a skip-chain conditional random field over base detectors.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. The field labels
further tokens that look alike or recur: its nodes are the base spans (whose labels are
given) and all other tokens with a digit or an at sign; neighbours in the text are joined by
chain edges, and tokens of one document that are equal or share their last digits, however
far apart, by skip edges. Loopy message passing makes labels consistent across a document;
tokens whose label is sure enough become spans of their own, such as card numbers that
stand side by side, which the base pattern reads as one number and drops.

Weights are learnt by pseudo-likelihood from the base labels of at most about SAMPLE_ROWS
rows, a parameter; features are shapes, never the patterns themselves. Every text is read
whole, and all documents of a batch share one vectorised message passing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import extended, place_of

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
SAMPLE_ROWS = 5_000
SURE = 0.9
CHAIN_GAP = 40  # characters between neighbours
SKIP_DIGITS = 7

_SLICE_CHARS = 4 << 20
_ROUNDS = 30
_TYPE = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,probability:double>>"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NODE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EDGE = ".,;:!?\"'[]{}<>*#%&$|=~`()"
_HINT = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from each at sign: linear also in endless words."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append((start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the base patterns, ordered by kind and start."""
    if not _HINT.search(text):
        return []
    found = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


def _shape(token: str) -> list[int]:
    """Numbers of the features that a token has."""
    digits = _NOT_DIGIT.sub("", token)
    letters = sum(c.isalpha() for c in token)
    dots, n = token.count("."), len(digits)
    parts = token.split(".")
    return [
        0,
        1 + int(np.searchsorted([1, 4, 7, 9, 13, 20], n, side="right")),  # 1..7
        8 + min(dots, 4),  # 8..12
        13 + (letters > 0) + (2 * letters > len(token)),  # 13..15
        16 + int(np.searchsorted([7, 16, 25], len(token), side="right")),  # 16..19
        20 + ("@" in token),
        22 + (13 <= n <= 19 and luhn(digits)),
        24 + (len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)),
        26 + token.startswith("+"),
        28 + ("(" in token or ")" in token),
        30 + ("-" in token),
    ]


FEATURES = 32


def _keys(token: str) -> list[str]:
    """What skip edges join tokens by."""
    plain = re.sub(r"[\W_]+", "", token).lower()
    digits = _NOT_DIGIT.sub("", token)
    keys = [plain] if len(plain) >= 5 else []
    if len(digits) >= SKIP_DIGITS:
        keys.append("#" + digits[-SKIP_DIGITS:])
    return keys


class Graph:
    """Nodes and edges of the documents of a batch."""

    def __init__(self):
        self.docs, self.spans, self.given, self.shapes, self.edges = [], [], [], [], []  # an edge: (a, b, 1 if skip)

    def add(self, doc: int, text: str, base: list[tuple[int, int, int]]) -> None:
        nodes = [(s, e, k) for k, s, e in base]
        taken = sorted((s, e) for s, e, _ in nodes)
        at = 0
        reach = -1
        for m in _NODE.finditer(text):
            while at < len(taken) and taken[at][0] < m.end():
                reach = max(reach, taken[at][1])
                at += 1
            if reach > m.start():
                continue
            token = m[0]
            start = m.start() + len(token) - len(token.lstrip(_EDGE))
            token = token.strip(_EDGE)
            if _HINT.search(token):
                nodes.append((start, start + len(token), OTHER))
        nodes.sort()
        first, seen = len(self.docs), {}
        for i, (start, end, kind) in enumerate(nodes, first):
            token = text[start:end]
            if i > first and start - self.spans[-1][1] <= CHAIN_GAP:
                self.edges.append((i - 1, i, 0))
            for key in _keys(token):
                if (before := seen.get(key)) is not None and (not self.edges or self.edges[-1] != (before, i, 1)):
                    self.edges.append((before, i, 1))
                seen[key] = i
            self.docs.append(doc)
            self.spans.append((start, end))
            self.given.append(kind)
            self.shapes.append(_shape(token))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        edges = np.array(self.edges, np.int64).reshape(-1, 3)
        return np.array(self.given, np.int64), np.array(self.shapes, np.int64).reshape(-1, 11), edges


def _summed(size: int, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.zeros((size, rows.shape[1]))
    np.add.at(out, at, rows)
    return out


def learn_weights(given: np.ndarray, shapes: np.ndarray, edges: np.ndarray, steps: int = 300, ridge: float = 1e-3) -> dict:
    """Weights by pseudo-likelihood: each node's label given its shape and its neighbours' labels.

    The weight of agreeing across a skip edge starts at 2, where a sample without such edges leaves it.
    """
    labels = OTHER + 1
    node, chain, skip = np.zeros((FEATURES, labels)), np.zeros((labels, labels)), 2.0
    n = len(given)
    if n == 0:
        return {"node": node, "chain": chain, "skip": skip}
    truth = np.eye(labels)[given]
    near = np.zeros((2, n, labels))
    for kind in (0, 1):
        some = edges[edges[:, 2] == kind]
        near[kind] = _summed(n, some[:, 0], truth[some[:, 1]]) + _summed(n, some[:, 1], truth[some[:, 0]])
    x = np.zeros((n, FEATURES))
    np.put_along_axis(x, shapes, 1.0, axis=1)
    moment = [np.zeros_like(node), np.zeros_like(chain), 0.0]
    for _ in range(steps):  # gradient ascent with steps scaled by past gradients
        score = x @ node + near[0] @ chain + skip * near[1]
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        miss = truth - p
        grads = [x.T @ miss / n - ridge * node, near[0].T @ miss / n, float((near[1] * miss).sum() / n) - ridge * (skip - 2.0)]
        grads[1] = (grads[1] + grads[1].T) / 2 - ridge * chain
        moment = [m + g * g for m, g in zip(moment, grads, strict=True)]
        node = node + 0.5 * grads[0] / (np.sqrt(moment[0]) + 1e-6)
        chain = chain + 0.1 * grads[1] / (np.sqrt(moment[1]) + 1e-6)
        skip = max(0.0, skip + 0.1 * grads[2] / (moment[2] ** 0.5 + 1e-6))
    return {"node": node, "chain": chain, "skip": float(skip)}


def infer(given: np.ndarray, shapes: np.ndarray, edges: np.ndarray, weights: dict) -> np.ndarray:
    """Label probabilities of all nodes by loopy message passing; nodes with a base label keep it."""
    labels = OTHER + 1
    own = weights["node"][shapes].sum(axis=1)
    own = np.where((given < OTHER)[:, None], np.where(np.eye(labels)[given] > 0, 0.0, -50.0), own)
    if len(edges):
        pair = np.stack([weights["chain"], weights["skip"] * np.eye(labels)])[edges[:, 2]]
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        messages = np.zeros((len(source), labels))
        for _ in range(_ROUNDS):
            belief = own + _summed(len(given), target, messages)
            sent = (belief[source] - messages[back])[:, :, None] + pair
            top = sent.max(axis=1)
            new = top + np.log(np.exp(sent - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            moved = np.abs(new - messages).max()
            messages = 0.5 * messages + 0.5 * new
            if moved < 1e-4:
                break
        own = own + _summed(len(given), target, messages)
    p = np.exp(own - own.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def find_spans(texts: list[str | None], weights: dict, sure: float = SURE) -> list[list[tuple]]:
    """(kind, start, end, base, probability) per text, ordered by kind and start."""
    found: list[list[tuple]] = [[] for _ in texts]
    graph = Graph()
    for i, text in enumerate(texts):
        if text and _HINT.search(text):
            base = base_spans(text)
            found[i] = [(k, s, e, True, 1.0) for k, s, e in base]
            graph.add(i, text, base)
    if graph.docs:
        given, shapes, edges = graph.arrays()
        p = infer(given, shapes, edges, weights)
        for at in np.flatnonzero((given == OTHER) & (p[:, :OTHER].max(axis=1) >= sure)):
            kind = int(p[at, :OTHER].argmax())
            found[graph.docs[at]].append((kind, *graph.spans[at], False, float(p[at, kind])))
    return [sorted(f) for f in found]


def learn(docs: DataFrame, text: str, key: str, rows: int = SAMPLE_ROWS) -> dict:
    """Weights from about `rows` rows at most, picked by a hash of their key."""
    rate = min(1.0, rows / max(1, docs.count()))
    mark = F.pmod(F.xxhash64(F.col(key), F.lit("crf")), F.lit(1 << 30))
    some = docs.filter(mark < int(rate * (1 << 30))).select(F.col(text).alias("text")).filter(F.col("text").rlike("[0-9@]"))

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            graph = Graph()
            for i, body in enumerate(batch.column(0).to_pylist()):
                graph.add(i, body, base_spans(body))
            given, shapes, edges = graph.arrays()
            yield pa.RecordBatch.from_pydict({"given": [given.tolist()], "shapes": [shapes.ravel().tolist()], "edges": [edges.ravel().tolist()]})

    given, shapes, edges, before = [], [], [], 0
    for row in some.mapInArrow(nodes, "given array<long>, shapes array<long>, edges array<long>").collect():  # bounded by `rows`
        part = np.array(row.edges, np.int64).reshape(-1, 3)
        edges.append(part + np.array([before, before, 0]))
        given.append(np.array(row.given, np.int64))
        shapes.append(np.array(row.shapes, np.int64).reshape(-1, 11))
        before += len(row.given)
    if not before:
        return learn_weights(np.zeros(0, np.int64), np.zeros((0, 11), np.int64), np.zeros((0, 3), np.int64))
    return learn_weights(np.concatenate(given), np.concatenate(shapes), np.concatenate(edges))


def personal_data(
    docs: DataFrame, text: str = "text", key: str = "doc_id", sample_rows: int = SAMPLE_ROWS, sure: float = SURE
) -> DataFrame:
    """`docs` with pii: (kind, start, end, base, probability), in code points, end exclusive, by kind and start.

    Null and empty texts have none. Where nothing could be learnt (no token with a digit or an
    at sign in the sample) only base spans come back. Equal rows get equal spans. A column
    `pii` of `docs` is replaced.
    """
    weights = docs.sparkSession.sparkContext.broadcast(learn(docs, text, key, sample_rows))
    rest = docs.drop("pii")
    at = place_of(rest, text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("probability", pa.float64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, start, held = batch.column(at).to_pylist(), 0, 0
            for end in range(1, len(texts) + 1):
                held += len(texts[end - 1] or "")
                if held < _SLICE_CHARS and end < len(texts):
                    continue
                found = find_spans(texts[start:end], weights.value, sure)
                rows = [[{"kind": KINDS[k], "start": s, "end": e, "base": b, "probability": p} for k, s, e, b, p in f] for f in found]
                yield batch.slice(start, end - start).append_column("pii", pa.array(rows, kind))
                start, held = end, 0

    return rest.mapInArrow(find, extended(rest, f"pii {_TYPE}"))
