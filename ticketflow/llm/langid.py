"""Language identification with segmentation-marginalised unigrams.

The vocabulary is a fixed public one; a language is a probability for each of
its pieces.  The probability of a marked word under a language is the sum over
all of its segmentations into pieces (forward algorithm), that of a text the
product over its words.  Piece probabilities are learned by one expectation
step over all training texts: every segmentation of a word weighs as under
uniform pieces, and the expected piece counts per language, smoothed, become
the probabilities.

Words are handled once: the distinct words of a block of whole texts run through
the lattice together, all languages at once, and a bounded pool (``POOL`` words,
then anew) remembers them for the next blocks of the task.  A word of more than
``PART_BYTES`` bytes is scored in consecutive parts (at character
boundaries), so a text without white space costs no more than any other.

Training combines map-side: a task emits at most one count per (language,
piece); the model (pieces x languages numbers, at most ``MAX_LANGUAGES``
languages) is what reaches the driver and the tasks of the second pass.

Defined results: ``und`` with score 0 for a text that is null or has no
letter, or if nothing was learned; ties go to the language of the smaller
code point order; a row without a doc_id is held out; repeated rows weigh
twice in training and give repeated predictions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketflow.llm.blocks import U64, SpanHash, text_blocks

MARK = "▁"
PIECE_BYTES = 16        # longer pieces of the vocabulary are not used
PART_BYTES = 24
SMOOTHING = 0.05
FLOOR = 1e-12           # 27 bytes of it stay inside a double
UNKNOWN_START = 1e-3    # weight of an unknown character against a piece in training
MAX_LANGUAGES = 512
BLOCK = 4 << 20
CHUNK = 16_384          # distinct words in the lattice at a time
POOL = 400_000          # distinct words a task remembers
LETTER = re.compile(r"[^\W\d_]")
MARKED = 1 << 20        # salt of spans that begin a word


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Ids of byte spans that are pieces (``n`` = unknown character, -1 = no piece)."""

    SLOTS = 1 << 20

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        seen = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
                continue
            marked = piece.startswith(MARK)
            body = piece[marked:].encode()
            if MARK not in piece[marked:] and len(body) <= PIECE_BYTES:
                seen[body, marked] = None
        # the marker alone opens a word without consuming a byte of it
        self.alone = list(seen).index((b"", True)) if (b"", True) in seen else None
        self.n = len(seen)
        data = np.frombuffer(b"".join(b for b, _ in seen) + b"\0", np.uint8)
        end = np.cumsum([len(b) for b, _ in seen])
        start = end - [len(b) for b, _ in seen]
        marked = np.array([m for _, m in seen])
        span = SpanHash(data)
        self.hashes = np.where(marked, span(start, end, MARKED), span(start, end))
        self.slots = np.full((2, self.SLOTS), -1, np.int32)
        for i, (a, b) in enumerate(zip(*map(np.ndarray.tolist, self._slots(self.hashes)))):
            # one of two places; with 30,000 pieces in 2 x 1M places both are all but never taken
            place = (0, a) if self.slots[0, a] < 0 else (1, b)
            if self.slots[place] >= 0:
                raise ValueError("no free place for a piece")
            self.slots[place] = i

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> U64(44)).astype(np.int64), (h & U64(self.SLOTS - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        a, b = self._slots(h)
        first, second = self.slots[0][a], self.slots[1][b]
        return np.where((first >= 0) & (self.hashes[first] == h), first,
                        np.where((second >= 0) & (self.hashes[second] == h), second, -1))


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """The vocabulary, built once per Python worker."""
    return Pieces(path)


class Lattice:
    """All segmentations of a chunk of distinct word parts, longest first."""

    def __init__(self, pieces: Pieces, data: np.ndarray, span: SpanHash, start: np.ndarray, end: np.ndarray,
                 marked: np.ndarray):
        length = end - start
        self.n, self.length = len(start), length
        self.steps = []     # (from, to, rows, piece ids), by start position
        longest = int(length[0]) if self.n else 0
        lead = np.zeros(256, np.int64)
        lead[:0x80], lead[0xC0:0xE0], lead[0xE0:0xF0], lead[0xF0:] = 1, 2, 3, 4
        for i in range(longest):
            m = int(np.searchsorted(-length, -i, "left"))       # rows longer than i
            begins = lead[data[start[:m] + i]]
            open_rows = np.flatnonzero(begins)
            self.steps.append((i, None, open_rows, begins[open_rows]))
            for j in range(i + 1, min(i + PIECE_BYTES, longest) + 1):
                rows = open_rows[:np.searchsorted(-length[open_rows], -j, "right")]
                if not len(rows):
                    break
                ids = pieces.find(span(start[rows] + i, start[rows] + j))
                hit = np.flatnonzero(ids >= 0)
                self.steps.append((i, j, rows[hit], ids[hit]))
        self.opening = []   # pieces that begin with the marker
        rows = np.flatnonzero(marked)
        for j in range(1, min(PIECE_BYTES, longest) + 1):
            at = rows[:np.searchsorted(-length[rows], -j, "right")]
            if not len(at):
                break
            ids = pieces.find(span(start[at], start[at] + j, MARKED))
            hit = np.flatnonzero(ids >= 0)
            self.opening.append((j, at[hit], ids[hit]))
        self.marked, self.pieces, self.longest = marked, pieces, longest

    def _edges(self):
        """(from, to, rows, ids); an unknown character is an edge of its own."""
        for i, j, rows, ids in self.steps:
            if j is None:
                for width in (1, 2, 3, 4):
                    at = rows[ids == width]
                    at = at[self.length[at] >= i + width]
                    if len(at):
                        yield i, i + width, at, np.full(len(at), self.pieces.n)
            elif len(rows):
                yield i, j, rows, ids

    def forward(self, p: np.ndarray) -> np.ndarray:
        """(rows, positions, languages) sums over segmentations up to each position."""
        alpha = np.zeros((self.n, self.longest + 5, p.shape[1]))
        alpha[:, 0] = np.where(self.marked[:, None], p[self.pieces.alone] if self.pieces.alone is not None else 1.0, 1.0)
        for j, rows, ids in self.opening:
            alpha[rows, j] += p[ids]
        for i, j, rows, ids in self._edges():
            alpha[rows, j] += alpha[rows, i] * p[ids]
        return alpha

    def totals(self, p: np.ndarray) -> np.ndarray:
        return self.forward(p)[np.arange(self.n), self.length]

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts (pieces + unknown, languages) for weighted rows."""
        alpha = self.forward(p)[:, :, 0]
        beta = np.zeros_like(alpha)
        at = np.arange(self.n)
        beta[at, self.length] = 1.0
        total = alpha[at, self.length]
        scale = np.divide(1.0, total, out=np.zeros_like(total), where=total > 0)
        flat, mass, owner = [], [], []
        q = p[:, 0]
        for i, j, rows, ids in reversed(list(self._edges())):
            flow = q[ids] * beta[rows, j]
            beta[rows, i] += flow
            flat.append(ids)
            owner.append(rows)
            mass.append(flow * alpha[rows, i] * scale[rows])
        for j, rows, ids in self.opening:
            flat.append(ids)
            owner.append(rows)
            mass.append(q[ids] * beta[rows, j] * scale[rows])
        if self.pieces.alone is not None:
            rows = np.flatnonzero(self.marked)
            flat.append(np.full(len(rows), self.pieces.alone))
            owner.append(rows)
            mass.append(alpha[rows, 0] * beta[rows, 0] * scale[rows])
        ids, rows, mass = np.concatenate(flat), np.concatenate(owner), np.concatenate(mass)
        return np.stack([np.bincount(ids, mass * weight[rows, lang], minlength=self.pieces.n + 1)
                         for lang in range(weight.shape[1])], axis=1)


def _parts(block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, marked flag and text of each word part of a block."""
    length = block.end - block.start
    n = np.maximum(-(-length // PART_BYTES), 1)
    word = np.repeat(np.arange(len(length)), n)
    k = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
    start = block.start[word] + k * PART_BYTES
    for _ in range(3):      # back to the first byte of a character
        start = np.where((k > 0) & ((block.data[start] & 0xC0) == 0x80), start - 1, start)
    end = block.end[word].copy()
    same = word[1:] == word[:-1]
    end[:-1][same] = start[1:][same]
    return start, end, k == 0, block.text_of_word()[word]


def _distinct(block, span: SpanHash):
    """Distinct parts by key (key, start, end, marked), and for every part its distinct index and text."""
    start, end, marked, text = _parts(block)
    key = np.where(marked, span(start, end, MARKED), span(start, end))
    key, one, inverse = np.unique(key, return_index=True, return_inverse=True)
    return key, start[one], end[one], marked[one], inverse, text


def _lattices(pieces: Pieces, data: np.ndarray, span: SpanHash, start: np.ndarray, end: np.ndarray,
              marked: np.ndarray) -> Iterator[tuple[np.ndarray, Lattice]]:
    """(rows, lattice) of chunks of word parts, longest first."""
    order = np.argsort(start - end, kind="stable")
    for lo in range(0, len(order), CHUNK):
        rows = order[lo:lo + CHUNK]
        yield rows, Lattice(pieces, data, span, start[rows], end[rows], marked[rows])


class Pool:
    """Columns of values by key, sorted by key."""

    def __init__(self, **columns):
        self.empty = {"key": np.zeros(0, U64), **columns}
        self.clear()

    def clear(self) -> None:
        self.columns = dict(self.empty)

    def __len__(self) -> int:
        return len(self.columns["key"])

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of each key, whether it is known)."""
        if not len(self):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self["key"], key), len(self) - 1)
        return at, self["key"][at] == key

    def add(self, **columns) -> None:
        merged = {n: np.concatenate([c, columns[n]]) for n, c in self.columns.items()}
        order = np.argsort(merged["key"], kind="stable")
        self.columns = {n: c[order] for n, c in merged.items()}


def train(df: DataFrame, text: str, lang: str, vocabulary: str) -> tuple[list[str], np.ndarray]:
    """(languages in code point order, probabilities (pieces + unknown, languages))."""
    langs = sorted(r[0] for r in df.select(lang).where(F.col(lang).isNotNull()).distinct().limit(
        MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not langs:
        return [], np.zeros((0, 0))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(vocabulary)
        uniform = np.full((pieces.n + 1, 1), 1.0 / pieces.n)
        uniform[pieces.n] = UNKNOWN_START / pieces.n
        counts = np.zeros((pieces.n + 1, len(langs)))
        index = {x: i for i, x in enumerate(langs)}
        none = np.zeros(0, np.int64)
        pool = Pool(start=none, size=none, marked=none.astype(bool), weight=np.zeros((0, len(langs))))
        letters: list[np.ndarray] = []      # bytes of the pooled words

        def spend() -> None:
            """Adds the expected counts of the pooled words and empties the pool."""
            if len(pool):
                data = np.concatenate(letters)
                for rows, lattice in _lattices(pieces, data, SpanHash(data), pool["start"], pool["start"] + pool["size"],
                                               pool["marked"]):
                    np.add(counts, lattice.expected(uniform, pool["weight"][rows]), out=counts)
            pool.clear()
            letters.clear()

        for batch in batches:
            of = np.array([index[x] for x in batch.column(1).to_pylist()], np.int64)
            for block in text_blocks(batch.column(0), BLOCK):
                if not len(block.start):
                    continue
                key, start, end, marked, which, owner = _distinct(block, SpanHash(block.data))
                weight = np.bincount(which * len(langs) + of[block.lo + owner],
                                     minlength=len(key) * len(langs)).reshape(len(key), len(langs)).astype(float)
                at, known = pool.find(key)
                pool["weight"][at[known]] += weight[known]
                new = np.flatnonzero(~known)
                size = (end - start)[new]
                begin = np.cumsum(size) - size
                held = sum(map(len, letters))
                letters.append(block.data[np.repeat(start[new] - begin, size) + np.arange(size.sum())])
                pool.add(key=key[new], start=held + begin, size=size, marked=marked[new], weight=weight[new])
                if len(pool) > POOL:
                    spend()
        spend()
        piece, of = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(piece, pa.int32()),
                                          pa.array(counts[piece, of], pa.float64())], names=["lang", "piece", "n"])

    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(text, lang)
    # summed as integers: the order of addition, and so the model, never varies
    sums = known.mapInArrow(count, "lang int, piece int, n double").groupBy("lang", "piece").agg(
        F.sum(F.round(F.col("n") * 1e6).cast("long")).alias("n")).toArrow()
    counts = np.full((pieces_of(vocabulary).n + 1, len(langs)), SMOOTHING)
    counts[sums["piece"].to_numpy(), sums["lang"].to_numpy()] += sums["n"].to_numpy() / 1e6
    return langs, np.maximum(counts / counts.sum(axis=0), FLOOR)


def predict(df: DataFrame, model: tuple[list[str], np.ndarray], vocabulary: str, text: str = "text") -> DataFrame:
    """``df`` plus a struct column ``language`` (``lang``, ``score``); an input column of
    that name is replaced.  ``score`` is the posterior with equal priors."""
    langs, p = model
    shared = df.sparkSession.sparkContext.broadcast(p)

    @F.arrow_udf("lang string, score double")
    def scored(column: pa.Array) -> pa.Array:
        lang, score = ["und"] * len(column), np.zeros(len(column))
        if langs:
            pieces, q = pieces_of(vocabulary), shared.value
            pool = Pool(logs=np.zeros((0, len(langs)), np.float64))
            for block in text_blocks(column, BLOCK):
                sums = np.zeros((block.hi - block.lo, len(langs)))
                if len(block.start):
                    span = SpanHash(block.data)
                    key, start, end, marked, which, owner = _distinct(block, span)
                    at, known = pool.find(key)
                    logs = np.empty((len(key), len(langs)))
                    logs[known] = pool["logs"][at[known]]
                    new = np.flatnonzero(~known)
                    for rows, lattice in _lattices(pieces, block.data, span, start[new], end[new], marked[new]):
                        logs[new[rows]] = np.log(np.maximum(lattice.totals(q), 1e-320))
                    if len(pool) + len(new) > POOL:
                        pool.clear()
                        new = np.arange(len(key))
                    pool.add(key=key[new], logs=logs[new])
                    for i in range(len(langs)):
                        sums[:, i] = np.bincount(owner, logs[which, i], minlength=len(sums))
                for i, t in enumerate(column.slice(block.lo, len(sums)).to_pylist()):
                    if t and LETTER.search(t):
                        best = int(np.argmax(sums[i]))
                        lang[block.lo + i] = langs[best]
                        score[block.lo + i] = 1.0 / np.exp(sums[i] - sums[i, best]).sum()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], names=["lang", "score"])

    columns = [F.col(f"`{c}`") for c in df.columns if c.lower() != "language"]
    return df.select(*columns, scored(F.col(text)).alias("language"))


def held_out(modulus: int, remainder: int) -> Column:
    """True where crc32(doc_id as text) leaves this remainder, or there is no doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def op2_langid(spark, sf_dir: str) -> DataFrame:
    from ticketflow.llm.tables import table

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("held_out", held_out(5, 0))
    vocabulary = default_vocabulary()
    model = train(docs.where(~F.col("held_out")), "text", "lang", vocabulary)
    found = predict(docs.select("doc_id", "held_out", "text"), model, vocabulary)
    return found.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"),
                        F.col("language.score").alias("score"))
