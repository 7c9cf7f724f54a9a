"""Personal data: base patterns, and a skip-chain conditional random field.

Tokens are white-space words that hold a digit or an at-sign. A token's label is
email, ip, card, phone or none. Neighbouring tokens share a chain potential;
tokens with the same normalised content, however far apart, share a skip
potential with one hub node that stands for the content, so any two of them are
two links apart and links grow with the tokens. Loopy sum-product messages, run
until they settle in each document by itself, make the labels of a document's
repeated entities agree. The weights are learned from the base patterns' own findings, and from
spoiled copies of the tokens as counterexamples, by pseudo-likelihood on a
bounded sample of documents (``FIT_DOCUMENTS``).
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

from .common import id_text, written
from .secret_scan import count_of, joined

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
FOUND = tuple(f"crf_{k}" for k in KINDS)  # kinds of the spans that the field adds
FIT_DOCUMENTS = 2000    # documents in the sample that fits the weights
FIT_TOKENS = 200        # a sampled document has at most so many tokens
SETTLED = 1e-4          # largest change of a log message, undamped, in a document whose messages have settled
PATIENCE = 50           # sweeps without a smaller change after which a document's step is halved
LEAST_STEP = 1 / 64     # a document whose messages swing even at this step hasn't settled
EVIDENCE = 8.0          # log-odds that a token inside a base span has the span's kind
CONFIDENT = 0.7         # least marginal of a label that is reported

# Character sets and patterns of the contract.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for at, d in enumerate(reversed(digits)):
        n = int(d) * (1 + at % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's matches, found from the at-signs so that long words cost linear time."""
    free, at = 0, text.find("@")
    while at >= 0:
        local = text[free:at]
        start = at - (len(local) - len(local.rstrip(LOCAL)))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Groups of four parts from the left of every dotted run of numbers."""
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        start = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = start + sum(map(len, four)) + 3
            short = [p.lstrip("0") for p in four]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in short):
                yield start, end
            start = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the four patterns by kind, then start; offsets in code points, end exclusive."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", a, b) for a, b in _ips(text)]
    for m in CARD.finditer(text):
        if 16 <= len(m[0]):
            digits = re.sub("[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


@dataclass
class Token:
    start: int
    end: int
    word: int     # number of the word in the text
    text: str
    before: str   # the word before, lower-cased


_WORD = re.compile(r"\S+")
_ACTIVE = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[^0-9]")
CUES = tuple(re.compile(p) for p in (
    r"e-?mails?|mail|contact|mailto", r"ip|host|server|address|addr", r"cards?|visa|mastercard|credit",
    r"phones?|tel|telephone|call|fax|mobile|cell"))


def tokens(text: str) -> list[Token]:
    if not _ACTIVE.search(text):
        return []
    out, before = [], ""
    for number, m in enumerate(_WORD.finditer(text)):
        word = m[0]
        if _ACTIVE.search(word):
            out.append(Token(m.start(), m.end(), number, word, before.lower().strip(".,:;")))
        before = word[-24:]
    return out


_DOTS = re.compile(r"[0-9]+(?:\.[0-9]+)+")


def key(token: str) -> str | None:
    """What repeated or similar tokens have in common: an address without case or edges, long digits, a dotted number."""
    if "@" in token:
        return token.strip(".,;:<>()[]\"'").lower()
    digits = _DIGITS.sub("", token)
    if len(digits) >= 7:
        return digits[-10:]
    dotted = _DOTS.search(token)
    return dotted[0] if dotted else None


def observe(token: Token) -> list[float]:
    t = token.text.strip(",;:!?\"'")
    digits = _DIGITS.sub("", t)
    n = len(digits)
    letters = any(c.isalpha() for c in t)
    return [1.0, "@" in t, bool(re.search(r"@[\w-]+(\.[\w-]+)+", t)), letters, letters and "@" not in t and n > 0,
            t.startswith("+"), "(" in t or ")" in t, "=" in t or ":" in t, "/" in t or "_" in t,
            n == 0, 1 <= n <= 2, n == 3, n == 4, 5 <= n <= 6, n == 7, 8 <= n <= 11, 12 <= n <= 15, 16 <= n <= 19, n > 19,
            bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}\.?", t)), bool(re.fullmatch(r"[0-9]{3}-[0-9]{4}\.?", t)),
            13 <= n <= 19 and luhn(digits), t.isdigit(), "." in t.rstrip("."), "-" in t.strip("-"),
            *(bool(c.fullmatch(token.before)) for c in CUES)]


WIDTH = len(observe(Token(0, 1, 0, "0", "")))


@dataclass
class Graph:
    """Tokens of several documents with their links; documents share none."""

    features: np.ndarray
    chain: np.ndarray   # rows (left, right)
    skip: np.ndarray    # rows (token, number of its hub)
    document: np.ndarray | None = None  # each token's; None: all are of one

    @property
    def hubs(self) -> int:
        return int(self.skip[:, 1].max()) + 1 if len(self.skip) else 0

    @staticmethod
    def of(documents: list[list[Token]]) -> Graph:
        features, chain, skip, document, hubs = [], [], [], [], 0
        for number, doc in enumerate(documents):
            first = len(features)
            document += [number] * len(doc)
            places: dict[str, list[int]] = {}
            for k, token in enumerate(doc):
                features.append(observe(token))
                if k and token.word == doc[k - 1].word + 1:
                    chain.append((first + k - 1, first + k))
                name = key(token.text)
                if name:
                    places.setdefault(name, []).append(first + k)
            for same in places.values():
                if len(same) > 1:
                    skip += [(at, hubs) for at in same]
                    hubs += 1
        pairs = [np.array(x, np.int64).reshape(-1, 2) for x in (chain, skip)]
        return Graph(np.array(features, float).reshape(len(features), WIDTH), *pairs, np.array(document, np.int64))


@dataclass
class Field:
    """``emit`` (features x labels), ``chain`` and ``skip`` (labels x labels, symmetric for skip)."""

    emit: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, graph: Graph, known: np.ndarray | None = None) -> np.ndarray:
        """Label probabilities of all tokens; ``known`` labels (0: unknown) are evidence."""
        return self.settled_marginals(graph, known)[0]

    def settled_marginals(self, graph: Graph, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of all tokens by damped loopy sum-product, and which documents' messages settled.

        Every document's messages run until what they would change to is within
        ``SETTLED`` of what they are, whatever other documents do. Where they swing
        instead, the document's step is halved, down to ``LEAST_STEP``; one that swings
        still is labelled by its tokens and the evidence alone.
        """
        unary = graph.features @ self.emit
        if known is not None:
            at = np.flatnonzero(known)
            unary[at, known[at]] += EVIDENCE
        tokens_n, m, s = len(unary), len(graph.chain), len(graph.skip)
        document = np.zeros(tokens_n, np.int64) if graph.document is None else graph.document
        calm = np.ones(int(document.max()) + 1 if tokens_n else 0, bool)
        if not m + s:
            return _softmax(unary), calm
        unary = np.concatenate([unary, np.zeros((graph.hubs, len(LABELS)))])
        skip = graph.skip + [0, tokens_n]
        ends = np.concatenate([graph.chain, graph.chain[:, ::-1], skip, skip[:, ::-1]])
        potentials = [np.exp(x) for x in (self.chain, self.chain.T, self.skip, self.skip.T)]
        sections = np.array([0, m, 2 * m, 2 * m + s, 2 * (m + s)])
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m), np.arange(2 * m + s, 2 * (m + s)),
                               np.arange(2 * m, 2 * m + s)])
        owner = document[np.concatenate([graph.chain[:, 0]] * 2 + [graph.skip[:, 0]] * 2)]
        message = np.zeros((len(ends), len(LABELS)))
        step, least, since = np.full(owner.max() + 1, 0.5), np.full(owner.max() + 1, np.inf), np.zeros(owner.max() + 1)
        live = np.arange(len(ends))  # links of the documents that haven't settled
        while len(live):
            belief = unary + _sum_at(ends[:, 1], message, len(unary))
            out = belief[ends[live, 0]] - message[back[live]]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            cuts = np.searchsorted(live, sections)
            sent = np.log(np.concatenate([out[a:b] @ x for a, b, x in zip(cuts, cuts[1:], potentials)]) + 1e-300)
            sent -= np.logaddexp.reduce(sent, axis=1, keepdims=True)
            change = np.zeros(len(step))
            np.maximum.at(change, owner[live], np.abs(sent - message[live]).max(axis=1))
            message[live] += step[owner[live], None] * (sent - message[live])
            since = np.where(change < least, 0, since + 1)
            least = np.minimum(least, change)
            swings = since >= PATIENCE
            step[swings] /= 2
            since[swings] = 0
            calm[:len(step)] &= step >= LEAST_STEP
            ended = (change < SETTLED) | (step < LEAST_STEP)
            if ended[owner[live]].any():
                live = live[~ended[owner[live]]]
        message[~calm[owner]] = 0
        return _softmax((unary + _sum_at(ends[:, 1], message, len(unary)))[:tokens_n]), calm


def _sum_at(where: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(where, values[:, k], n) for k in range(values.shape[1])], axis=1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(graph: Graph, labels: np.ndarray, steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Pseudo-likelihood: each token's label given its features and its neighbours' labels.

    A label of -1 marks a counterexample: none, at a fifth of a token's weight. A
    hub has no features, and the commonest label but none of its tokens.
    """
    k, skip_ends = len(LABELS), graph.skip + [0, len(labels)]
    share = np.where(labels < 0, 0.2, 1.0)
    labels = np.maximum(labels, 0)
    votes = np.zeros((graph.hubs, k))
    np.add.at(votes, (graph.skip[:, 1], labels[graph.skip[:, 0]]), 1)
    votes[:, 0] = 0  # where no token has another label, none is the first of equals
    labels = np.concatenate([labels, votes.argmax(axis=1)])
    share = np.concatenate([share, np.ones(graph.hubs)])[:, None]
    share /= max(share.sum(), 1)
    n = len(labels)
    features = np.concatenate([graph.features, np.zeros((graph.hubs, graph.features.shape[1]))])
    seen = np.eye(k)[labels]
    left = _sum_at(graph.chain[:, 1], seen[graph.chain[:, 0]], n)
    right = _sum_at(graph.chain[:, 0], seen[graph.chain[:, 1]], n)
    far = (_sum_at(skip_ends[:, 1], seen[skip_ends[:, 0]], n) + _sum_at(skip_ends[:, 0], seen[skip_ends[:, 1]], n))
    emit, chain, skip = np.zeros((features.shape[1], k)), np.zeros((k, k)), np.zeros((k, k))
    # a symmetric start: repeated tokens tend to agree even where the sample has none
    skip += np.eye(k)
    emit_step, chain_step, skip_step = (np.zeros_like(w) for w in (emit, chain, skip))
    for _ in range(steps):
        p = _softmax(features @ emit + left @ chain + right @ chain.T + far @ skip)
        error = (seen - p) * share
        of_skip = far.T @ error
        for step, weight, slope in ((emit_step, emit, features.T @ error - decay * emit),
                                    (chain_step, chain, left.T @ error + error.T @ right - decay * chain),
                                    (skip_step, skip, (of_skip + of_skip.T) / 2 - decay * (skip - np.eye(k)))):
            step *= 0.9
            step += rate * slope
            weight += step
    return Field(emit, chain, skip)


def weak_labels(doc: list[Token], spans: list[tuple[str, int, int]]) -> list[int]:
    """The kind of the base span that a token overlaps, else none."""
    spans = sorted(spans, key=lambda s: s[1])
    out, at, open_spans = [], 0, []  # both lists are in order; spans of one kind don't overlap, so few are open at once
    for token in doc:
        while at < len(spans) and spans[at][1] < token.end:
            open_spans.append(spans[at])
            at += 1
        open_spans = [s for s in open_spans if s[2] > token.start]
        out.append(LABELS.index(open_spans[0][0]) if open_spans else 0)
    return out


def spoiled(token: Token) -> list[Token]:
    """Look-alikes that hold no entity: other separators between the same characters."""
    texts = {re.sub(r"[^0-9A-Za-z]+", mark, token.text) for mark in (":", "x")} - {token.text}
    return [Token(0, len(t), 0, t, "") for t in sorted(texts) if _ACTIVE.search(t) and not base_spans(t)]


def field_spans(doc: list[Token], marginals: np.ndarray, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Runs of neighbouring tokens with one confident label that touch no base span."""
    label = np.where(marginals.max(axis=1) >= CONFIDENT, marginals.argmax(axis=1), 0).tolist()
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken], np.int64)
    reach = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else starts

    def free(token: Token) -> bool:
        at = int(np.searchsorted(starts, token.end))
        return not (at and reach[at - 1] > token.start)

    out: list[tuple[str, int, int]] = []
    run: list[Token] = []
    for k, token in enumerate([*doc, None]):
        joins = run and token and label[k] == label[k - 1] == 4 and token.word == run[-1].word + 1
        if run and not (joins and free(token)):
            text = run[-1].text
            end = run[-1].end - (len(text) - len(text.rstrip(".,;:!?\"'")))
            start = run[0].start + len(run[0].text) - len(run[0].text.lstrip("\"'<["))
            if start < end:
                out.append((FOUND[label[k - 1] - 1], start, end))
            run = []
        if token and label[k] and free(token):
            run.append(token)
    return out


_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
ORDER = (*KINDS, *FOUND)


def _find(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = part.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            docs = [tokens(t) for t in texts]
            graph = Graph.of([d for d in docs if d])
            known = [x for doc, spans in zip(docs, base) if doc for x in weak_labels(doc, spans)]
            marginals, calm = field.settled_marginals(graph, np.array(known)) if known else (None, None)
            rows, settled, used, number = [], [], 0, 0
            for doc, spans in zip(docs, base):
                settled.append(bool(calm[number]) if doc else True)
                if doc:
                    number += 1
                    spans = spans + field_spans(doc, marginals[used:used + len(doc)], spans)
                    used += len(doc)
                spans = sorted(spans, key=lambda s: (ORDER.index(s[0]), s[1], s[2]))
                rows.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, _SPAN_TYPE), pa.array(settled)],
                                             names=["doc_id", "spans", "settled"])


def _weak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features, labels and links of sampled documents, one row per token."""
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            doc = tokens(text)
            if not 0 < len(doc) <= FIT_TOKENS:
                continue
            labels = weak_labels(doc, base_spans(text))
            other = [t for token in doc for t in spoiled(token)]
            graph = Graph.of([doc, *([t] for t in other)])
            yield pa.RecordBatch.from_pydict({
                "doc_id": [doc_id], "labels": [labels + [-1] * len(other)],
                "features": [graph.features.ravel().tolist()], "chain": [graph.chain.ravel().tolist()],
                "skip": [graph.skip.ravel().tolist()]}, schema=_WEAK)


_WEAK = pa.schema([("doc_id", pa.int64()), ("labels", pa.list_(pa.int64())), ("features", pa.list_(pa.float64())),
                   ("chain", pa.list_(pa.int64())), ("skip", pa.list_(pa.int64()))])


def fit_field(docs: DataFrame, sample: int = FIT_DOCUMENTS) -> Field:
    """Weights from at most ``sample`` documents with tokens, chosen by a hash of their id.

    Only numbers of the sampled tokens reach the driver. Without any token, all
    emissions favour no label.
    """
    rows = id_text(docs)
    chosen = (rows.where(F.col("text").rlike("[0-9@]")).select("doc_id").where("doc_id is not null").distinct()
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # at most ``sample`` ids are broadcast, so no text moves
    weak = rows.join(F.broadcast(written(chosen, "fit-sample")), "doc_id", "left_semi").mapInArrow(
        _weak, "doc_id long, labels array<long>, features array<double>, chain array<long>, skip array<long>")
    got = weak.orderBy("doc_id").limit(sample).toPandas()
    if not len(got):
        none = Graph(np.eye(WIDTH), *(np.empty((0, 2), np.int64),) * 2)
        return fit(none, np.zeros(WIDTH, np.int64))
    counts = got["labels"].map(len).to_numpy()
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])

    def links(column: str) -> list[np.ndarray]:
        return [np.asarray(x, np.int64).reshape(-1, 2) for x in got[column]]

    chain = np.concatenate([x + at for x, at in zip(links("chain"), first)])
    hubs = np.cumsum([0] + [int(x[:, 1].max()) + 1 if len(x) else 0 for x in links("skip")])
    skip = np.concatenate([x + [at, hub] for x, at, hub in zip(links("skip"), first, hubs)])
    features = np.concatenate([np.asarray(x, float) for x in got["features"]]).reshape(-1, WIDTH)
    labels = np.concatenate([np.asarray(x, np.int64) for x in got["labels"]])
    return fit(Graph(features, chain, skip), labels)


def personal_spans(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``doc_id``, ``spans`` (array of kind, start, end) and ``settled`` for every row of ``docs``.

    Base kinds come first, then the field's (``crf_...``), each by start. ``settled`` is false where a document's
    messages never settle; its tokens are then labelled without those of its others. A null
    or empty text has no spans. A row without doc_id keeps its null; repeated rows
    each give a row. Other columns are not read. An empty table gives an empty
    result. ``field`` is fitted on ``docs`` unless given.
    """
    fitted = field or fit_field(docs)
    spans = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                      T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", spans),
                           T.StructField("settled", T.BooleanType())])
    return id_text(docs).mapInArrow(lambda it: _find(it, fitted), schema)


def personal_digests(docs: DataFrame) -> DataFrame:
    spans = F.col("spans")
    return personal_spans(docs).select(
        "doc_id", *(count_of(spans, k).alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(spans, KINDS), 256).alias("base_sha256"), joined(spans).alias("spans"), "settled")
