"""Toxicity by a linear-chain conditional random field over words.

Tokens are runs of letters and digits, A-Z lower-cased.  Each has two states
(clean, toxic); a token's emission score is the sum of the weights of its
features (the word, its first three to eight bytes, its last three and four), and neighbours are
tied by transition scores.  The document labels become labelled tokens first:
inside documents labelled toxic, a token is toxic if one of its features is
found in at least ``MIN_SHARE`` of the toxic training documents and makes up
``MIN_ODDS`` times as many of their words as of the clean documents' words.  The field is fitted to these sequences by gradient steps
on the conditional likelihood; forward-backward marginals of every whole text
then give the offending offsets (runs of tokens above ``SPAN_MARGINAL``) and, summed
to the number and density of toxic words and the surest one, the document
score (logistic regression on these sums).

Fitting uses a bounded sample of the labelled rows: at most ``SAMPLE_TOXIC``
toxic and ``SAMPLE_CLEAN`` clean documents of at most ``SAMPLE_CHARS``
characters, chosen by a hash of the doc_id; it runs in one executor task and
its result is the weight vector.  Scoring covers every row and whole texts:
the chain is evaluated in segments whose transfer matrices are combined, so a
very long text takes steps like the length of a segment, not of the text.

Defined results: null and empty texts score 0; without labelled rows of both
kinds every score is 0; a doc_id labelled both ways counts as toxic; rows
without a doc_id are held out; repeated rows give repeated scores and count
once in training.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.llm.blocks import LOWER, U64, SpanHash, text_blocks

SAMPLE_TOXIC = 1000
SAMPLE_CLEAN = 2000
SAMPLE_CHARS = 50_000
HASH_BITS = 18
PREFIXES = (3, 4, 5, 6, 7, 8)
SUFFIXES = (3, 4)
MIN_SHARE = 0.01        # of the toxic training documents that must hold a feature ...
MIN_DOCUMENTS = 3       # ... and at least so many of them
MIN_ODDS = 15.0         # how much more frequent among the words of toxic documents
TRAIN_TOKENS = 256      # longer documents are cut into training sequences
STEPS = 25
RATE = 0.3
DECAY = 2e-3
SEGMENT = 256
SPAN_MARGINAL = 0.5

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
BETWEEN = ~_LETTERS


@dataclass
class Field:
    """Weights of the feature hashes and the four transition scores."""

    weights: np.ndarray     # 2^HASH_BITS, score of toxic against clean
    bias: float
    transition: np.ndarray  # [from, to]
    document: np.ndarray | None = None  # weights of document_features


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(tokens, features) indices into the weights; shorter words repeat the word."""
    span = SpanHash(data)
    shift = U64(64 - HASH_BITS)
    columns = [span(start, end, 1 << 24)]
    for n in PREFIXES:
        columns.append(span(start, np.minimum(start + n, end), 2 << 24))
    for n in SUFFIXES:
        columns.append(span(np.maximum(end - n, start), end, 3 << 24))
    return np.stack([(c >> shift).astype(np.int64) for c in columns], axis=1)


def token_types(block) -> tuple[np.ndarray, np.ndarray]:
    """(features of the distinct tokens, distinct index of every token) of a block."""
    data = LOWER[block.data]
    h = SpanHash(data)(block.start, block.end)
    _, one, inverse = np.unique(h, return_index=True, return_inverse=True)
    return features(data, block.start[one], block.end[one]), inverse


# ---- the chain ------------------------------------------------------------

def _grid(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments of at most ``size`` tokens: (start of each, text of each)."""
    n = np.diff(first)
    parts = -(-n // size)
    text = np.repeat(np.arange(len(n)), parts)
    k = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    return first[:-1][text] + k * size, text


def marginals(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """P(toxic) of every token; texts are tokens first[i]..first[i + 1] - 1.

    Potentials are normalised at each step.  Segments run side by side: a
    first sweep gives each segment's transfer matrices, a short sweep along
    the segments of each text gives the messages at their edges, a last sweep
    fills in the tokens.
    """
    n = len(emission)
    out = np.zeros(n)
    if not n:
        return out
    start, text = _grid(first, segment)
    stop = np.minimum(start + segment, first[1:][text])
    length = stop - start
    order = np.argsort(-length, kind="stable")
    start, text, length = start[order], text[order], length[order]
    longest = int(length[0])
    toxic = 1.0 / (1.0 + np.exp(-np.clip(emission, -500, 500)))
    e = np.stack([1.0 - toxic, toxic], axis=1)
    a = np.exp(transition)
    a = a / a.sum()
    width = np.searchsorted(-length, -np.arange(longest), "left")   # segments longer than t
    m = len(start)
    # transfer of a segment: rows = state before it, columns = state at its end
    f = np.tile(np.eye(2), (m, 1, 1))
    for t in range(longest):
        w = width[t]
        g = (f[:w] @ a) * e[start[:w] + t][:, None, :]
        f[:w] = g / g.sum(axis=(1, 2), keepdims=True)
    # messages along the segments of a text
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    per_text = np.bincount(text, minlength=len(first) - 1)
    rank_first = np.cumsum(per_text) - per_text
    before = np.full((m, 2), 0.5)
    after = np.full((m, 2), 0.5)
    have = np.flatnonzero(per_text)
    # before its first token a text is in either state alike
    for k in range(1, int(per_text.max())):
        at = have[per_text[have] > k]
        prior = place[rank_first[at] + k - 1]
        v = np.einsum("ni,nij->nj", before[prior], f[prior])
        before[place[rank_first[at] + k]] = v / v.sum(axis=1, keepdims=True)
    for k in range(int(per_text.max()) - 2, -1, -1):
        at = have[per_text[have] > k + 1]
        following = place[rank_first[at] + k + 1]
        v = np.einsum("nij,nj->ni", f[following], after[following])
        after[place[rank_first[at] + k]] = v / v.sum(axis=1, keepdims=True)
    alpha = np.empty((n, 2))
    state = before
    for t in range(longest):
        w = width[t]
        g = (state[:w] @ a) * e[start[:w] + t]
        state = g / g.sum(axis=1, keepdims=True)
        alpha[start[:w] + t] = state
    back = after.copy()
    for t in range(longest - 1, -1, -1):
        w = width[t]
        at = start[:w] + t
        both = alpha[at] * back[:w]
        out[at] = both[:, 1] / both.sum(axis=1)
        g = (e[at] * back[:w]) @ a.T
        back[:w] = g / g.sum(axis=1, keepdims=True)
    return out


# ---- fitting --------------------------------------------------------------

def token_labels(types: np.ndarray, token: np.ndarray, text: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Labels of tokens from labels of texts: which features toxic texts use far more often."""
    size = 1 << HASH_BITS
    n = np.bincount(toxic, minlength=2)
    words = np.bincount(toxic[text], minlength=2)
    pair, times = np.unique(text * len(types) + token, return_counts=True)
    owner, kind = pair // len(types), pair % len(types)
    is_toxic = toxic[owner] == 1
    marked = np.zeros(len(types), bool)
    for column in range(types.shape[1]):
        f = types[kind, column]
        uses = [np.bincount(f[side], times[side], minlength=size) for side in (~is_toxic, is_toxic)]
        texts = np.bincount(np.unique(owner[is_toxic] * size + f[is_toxic]) % size, minlength=size)
        odds = ((uses[1] + 0.5) / (words[1] + 1)) / ((uses[0] + 0.5) / (words[0] + 1))
        marked |= ((texts >= max(MIN_DOCUMENTS, MIN_SHARE * n[1])) & (odds >= MIN_ODDS))[types[:, column]]
    return marked[token] & (toxic[text] == 1)


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What a text's marginals come to: how many toxic words, how dense, the surest, how long a text."""
    n = np.diff(first)
    have = np.flatnonzero(n)
    out = np.zeros((len(n), 5))
    out[:, 0] = 1.0
    if len(have):
        starts = first[:-1][have]
        total = np.add.reduceat(p, starts)
        out[have, 1] = np.log1p(total)
        out[have, 2] = np.log1p(100.0 * total / n[have])
        out[have, 3] = np.maximum.reduceat(p, starts)
        out[have, 4] = np.log1p(n[have]) / 10
    return out


def fit_documents(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression of the text labels (Newton steps, ridge on all but the constant)."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(30):
        q = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -40, 40)))
        hessian = (x * (q * (1 - q))[:, None]).T @ x + penalty
        w += np.clip(np.linalg.solve(hessian, x.T @ (y - q) - penalty @ w), -2, 2)
    return w


def fit(types: np.ndarray, token: np.ndarray, first: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Field:
    """Gradient steps (Adam) on the conditional log-likelihood of the labels."""
    size = 1 << HASH_BITS
    used, of = np.unique(types, return_inverse=True)
    of = of.reshape(types.shape)
    w = np.zeros(len(used) + 5)         # features, bias, transitions
    start, text = _grid(first, TRAIN_TOKENS)
    edges = np.append(start, first[-1])
    y = labels.astype(float)
    inner = np.ones(len(token), bool)
    inner[start] = False
    pair = np.flatnonzero(inner)
    want = np.bincount((labels[pair - 1] * 2 + labels[pair]).astype(np.int64), minlength=4).reshape(2, 2)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    scale = 1.0 / max(len(token), 1)
    for step in range(1, steps + 1):
        emission = (w[of].sum(axis=1) + w[len(used)])[token]
        transition = w[-4:].reshape(2, 2)
        p = marginals(emission, edges, transition)
        expected = _pairs(emission, edges, transition, p, pair)
        residual = np.bincount(token, y - p, minlength=len(types))
        grad = np.zeros_like(w)
        for column in range(of.shape[1]):
            grad[:len(used)] += np.bincount(of[:, column], residual, minlength=len(used))
        grad[len(used)] = residual.sum()
        grad[-4:] = (want - expected).ravel()
        grad = grad * scale * 100 - DECAY * w
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        w += RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-6)
    weights = np.zeros(size)
    weights[used] = w[:len(used)]
    return Field(weights, float(w[len(used)]), w[-4:].reshape(2, 2))


def _pairs(emission, edges, transition, p, pair) -> np.ndarray:
    """Expected transition counts, from the marginals of both ends of a pair.

    P(x, y) of neighbours is proportional to u_x a_xy v_y; u and v follow from
    the marginals by iterative scaling of the 2x2 table.
    """
    a = np.exp(transition)
    left, right = p[pair - 1], p[pair]
    table = np.empty((len(pair), 2, 2))
    table[:] = a
    row = np.stack([1 - left, left], axis=1)
    column = np.stack([1 - right, right], axis=1)
    for _ in range(3):
        table *= (row / np.maximum(table.sum(axis=2), 1e-300))[:, :, None]
        table *= (column / np.maximum(table.sum(axis=1), 1e-300))[:, None, :]
    return table.sum(axis=0)


def _train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) of the whole sample -> one row with the fitted field."""
    rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    weights = None
    if rows is not None and rows.num_rows:
        toxic = rows.column(1).to_numpy().astype(np.int64)
        column = rows.column(0).combine_chunks()
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if 0 < toxic.sum() < len(toxic):
            block = next(text_blocks(column, 1 << 40, BETWEEN))
            types, token = token_types(block)
            labels = token_labels(types, token, block.text_of_word(), toxic)
            if labels.any():
                f = fit(types, token, block.first, labels)
                p = marginals((f.weights[types].sum(axis=1) + f.bias)[token], block.first, f.transition)
                document = fit_documents(document_features(p, block.first), toxic.astype(float))
                weights = np.concatenate([f.weights, [f.bias], f.transition.ravel(), document])
    found = [] if weights is None else [weights.astype(np.float64).tobytes()]
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["field"])


def train(documents: DataFrame, labels: DataFrame, text: str = "text") -> Field | None:
    """Fit on a bounded sample of the labelled documents (None if one kind is missing)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    order = F.md5(F.col("doc_id").cast("string"))
    sample = (known.where("toxic = 1").orderBy(order).limit(SAMPLE_TOXIC)
              .unionAll(known.where("toxic = 0").orderBy(order).limit(SAMPLE_CLEAN)))
    # at most SAMPLE_TOXIC + SAMPLE_CLEAN ids of 12 bytes
    picked = documents.where(F.length(text) <= SAMPLE_CHARS).select("doc_id", F.col(text).alias("text")).join(
        F.broadcast(sample), "doc_id").dropDuplicates(["text"])
    rows = picked.orderBy(order).limit(SAMPLE_TOXIC + SAMPLE_CLEAN).select("text", F.col("toxic").cast("int"))
    found = rows.repartition(1).mapInArrow(_train, "field binary").first()
    if found is None:
        return None
    values = np.frombuffer(found["field"], np.float64)
    n = 1 << HASH_BITS
    return Field(values[:n], float(values[n]), values[n + 1:n + 5].reshape(2, 2), values[n + 5:])


# ---- scoring --------------------------------------------------------------

def score_block(block, field: Field) -> np.ndarray:
    """P(toxic) of every token of a block."""
    types, token = token_types(block)
    return marginals((field.weights[types].sum(axis=1) + field.bias)[token], block.first, field.transition)


def _code_points(block) -> np.ndarray:
    """Code points before each byte of the block, plus the total."""
    lead = (block.data & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(lead)])


def toxicity(df: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """``df`` plus a struct column ``toxicity``: ``score`` and ``spans`` (code point
    start and end of every run of toxic tokens).  An input column of that name is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(field)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf("score double, spans array<struct<start:long,end:long>>")
    def scored(column: pa.Array) -> pa.Array:
        score = np.zeros(len(column))
        spans: list = [[] for _ in range(len(column))]
        if shared.value is not None:
            for block in text_blocks(column, between=BETWEEN):
                if not len(block.start):
                    continue
                p = score_block(block, shared.value)
                x = document_features(p, block.first)
                have = np.flatnonzero(block.n_words)
                score[block.lo + have] = 1.0 / (1.0 + np.exp(-np.clip(x[have] @ shared.value.document, -40, 40)))
                hot = np.flatnonzero(p >= SPAN_MARGINAL)
                if len(hot):
                    points = _code_points(block)
                    owner = np.searchsorted(block.first, hot, "right") - 1
                    new = np.ones(len(hot), bool)
                    new[1:] = (hot[1:] != hot[:-1] + 1) | (owner[1:] != owner[:-1])
                    begin = np.flatnonzero(new)
                    last = np.append(begin[1:], len(hot)) - 1
                    zero = points[block.edges[owner[begin]]]
                    for i, s, e in zip(owner[begin], points[block.start[hot[begin]]] - zero,
                                       points[block.end[hot[last]]] - zero):
                        spans[block.lo + i].append({"start": int(s), "end": int(e)})
        return pa.StructArray.from_arrays([pa.array(np.clip(score, 0.0, 1.0)), pa.array(spans, span)],
                                          names=["score", "spans"])

    columns = [F.col(f"`{c}`") for c in df.columns if c.lower() != "toxicity"]
    return df.select(*columns, scored(F.col(text)).alias("toxicity"))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    from ticketflow.llm.langid import held_out
    from ticketflow.llm.tables import table

    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("held_out", held_out(4, 2))
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out(4, 2))
    field = train(docs.where(~F.col("held_out")), labels)
    found = toxicity(docs, field)
    return found.select("doc_id", "held_out", F.col("toxicity.score").alias("score"),
                        (F.col("toxicity.score") >= 0.3).cast("int").alias("predicted"),
                        F.size("toxicity.spans").alias("n_spans"))
