"""Token counts by rank-synchronous array merging.

White space never belongs to a token of the vocabulary, so a text is cut at
its ASCII white space into chunks and each distinct chunk is counted once per
worker; a text's count is the sum over its chunks.  The new chunks of a batch
are normalised and cut into pre-tokens by the vocabulary's own rules (the
tokenizers library's normaliser and pre-tokeniser, so no second copy of its
Unicode tables has to agree), and all their pre-tokens lie in one ragged numpy
array of symbols.  Each round finds the lowest rank of every sequence's
adjacent pairs, merges all occurrences of that pair in every sequence at
once (from the left where they overlap) and recomputes the ranks beside the
merged symbols; a sequence without a ranked pair is done and its surviving
symbols are its tokens.

Merging every occurrence at once equals merging them one by one because every
merge of the vocabulary ranks after the merges that make its two parts: no
merge can give a pair of a lower rank.  This is checked when the vocabulary is
loaded.  A pre-token of more than ``LONG`` symbols would need too many rounds
over all of its symbols; its pairs are taken in the same order from a heap.

The counts of chunks belong to one Python worker and are bounded
(``TABLE_ENTRIES`` chunks of at most ``CHUNK_CHARS`` characters; then they
start anew; longer chunks are counted each time they occur), so there is no
shuffle and a lost executor only repeats its own tasks.

Special strings of the vocabulary inside a text count as one token each, as
the library does by default; no begin or end token is counted and nothing is
cut off or padded.

Defined results: a null text counts as empty; an empty text, or one of white
space only, has 0 tokens; repeated rows give repeated results; all other
columns are kept, one named as the result column is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.session import ship_package

CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
TABLE_ENTRIES = 400_000
CHUNK_CHARS = 64
LONG = 2048
PARTS = 4096
TOKEN_LIMIT = 2048
NONE = np.iinfo(np.int64).max


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class MergeTable:
    """Symbols and ranked pairs of a BPE vocabulary with word ends, and the counts of chunks."""

    def __init__(self, path: str, entries: int = TABLE_ENTRIES):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("not a BPE vocabulary of plain symbols")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special strings that take text around them with them")
        self.vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        library = Tokenizer.from_file(path)
        self.normalise, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        if self.cut("\x20\x09\x0a\x0b\x0c\x0d") or self.normalise("a\x0bb") != "a b":
            raise ValueError("white space belongs to tokens: chunks are not independent")
        plain = "".join(map(chr, (c for c in range(128) if c != 32 and not 9 <= c <= 13)))
        if self.normalise(plain) != plain.lower():
            raise ValueError("the normaliser does more to ASCII text than lower-case it")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        left, right, made = (np.array([self.vocab[s] for s in column], np.int64) for column in zip(
            *((a, b, a + b) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]))))
        born = {}
        for rank, symbol in enumerate(made.tolist()):
            born[symbol] = rank
        first = np.arange(len(made))
        before = np.array([max(born.get(a, -1), born.get(b, -1)) for a, b in zip(left.tolist(), right.tolist())])
        if (before >= first).any():
            raise ValueError("a merge ranks before the merges of its parts: pairs depend on each other's order")
        self.size = max(self.vocab.values()) + 1
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.rank_of_key, self.made = keys[order], order, made
        # symbol of each character, inside a pre-token and at its end
        inner, last = {}, {}
        for symbol, i in self.vocab.items():
            if len(symbol) == 1:
                inner[ord(symbol)] = i
            if self.suffix and len(symbol) == 1 + len(self.suffix) and symbol.endswith(self.suffix):
                last[ord(symbol[0])] = i
        top = max([*inner, *last]) + 1
        self.inner, self.last = np.full(top, -1), np.full(top, -1)
        for table, found in ((self.inner, inner), (self.last, last if self.suffix else inner)):
            table[list(found)] = list(found.values())
        self.entries = entries
        self.counts: dict[str, int] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of_key[at], NONE)

    def symbols(self, pre_tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all pre-tokens one after another, symbols per pre-token)."""
        size = np.array([len(p) for p in pre_tokens], np.int64)
        chars = np.frombuffer("".join(pre_tokens).encode("utf-32-le"), np.uint32).astype(np.int64)
        found = self.inner[chars]
        ends = np.cumsum(size) - 1
        found[ends] = self.last[chars[ends]]
        if (found < 0).any():
            raise ValueError("a character without a symbol in the vocabulary")
        return found, size

    def merge(self, symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Surviving symbols of each ragged sequence."""
        out, symbols = size.copy(), symbols.copy()
        owner = np.repeat(np.arange(len(size)), size)
        ranks = np.full(len(symbols), NONE)
        inside = owner[1:] == owner[:-1]
        ranks[:-1][inside] = self._ranks(symbols[:-1][inside], symbols[1:][inside])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            length = np.diff(np.r_[starts, len(symbols)])
            least = np.minimum.reduceat(ranks, starts)
            out[owner[starts]] = length
            going = least != NONE
            if not going.all():
                stay = np.repeat(going, length)
                symbols, owner, ranks = symbols[stay], owner[stay], ranks[stay]
                length, least = length[going], least[going]
                if not len(symbols):
                    break
            at = np.flatnonzero(ranks == np.repeat(least, length))
            # occurrences that overlap lie side by side (a a a): every second one from the left
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            symbols[at] = self.made[ranks[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            moved = at - np.arange(len(at))     # places of the merged symbols after the others are gone
            symbols, owner = symbols[stay], owner[stay]
            ranks = ranks[stay]
            near = np.r_[moved, moved[moved > 0] - 1]
            ranks[near] = NONE
            near = near[near < len(symbols) - 1]
            near = near[owner[near] == owner[near + 1]]
            ranks[near] = self._ranks(symbols[near], symbols[near + 1])
        return out

    def merge_long(self, symbols: np.ndarray) -> int:
        """Surviving symbols of one long sequence: its pairs by rank, then place, from a heap."""
        sym, n = symbols.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self._ranks(symbols[:-1], symbols[1:])
        at = np.flatnonzero(ranks != NONE)
        heap = list(zip(ranks[at].tolist(), at.tolist(), symbols[at].tolist(), symbols[at + 1].tolist()))
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int, j: int) -> None:
            pair = sym[i], sym[j]
            rank = known.get(pair)
            if rank is None:
                rank = known[pair] = int(self._ranks(np.array([pair[0]]), np.array([pair[1]]))[0])
            if rank != NONE:
                heapq.heappush(heap, (rank, i, *pair))

        left = n
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
            left -= 1
        return left

    def _count_new(self, chunks: list[str]) -> None:
        """Count chunks that are not in the table yet."""
        whole = np.zeros(len(chunks), np.int64)
        parts, part_owner = [], []
        for k, chunk in enumerate(chunks):
            found = [chunk]
            if self.special is not None and self.special.search(chunk):
                found = self.special.split(chunk)
                whole[k] = len(found) - 1
            for part in found:
                # only A-Z change in ASCII text without white space (asked when the vocabulary is loaded)
                parts.append(part.lower() if part.isascii() else self.normalise(part))
                part_owner.append(k)
        # one call of the pre-tokeniser for many parts: a space between two belongs to no pre-token
        pre, owner = [], []
        for lo in range(0, len(parts), PARTS):
            group = parts[lo:lo + PARTS]
            edges = np.cumsum([0, *(len(p) + 1 for p in group)])
            found = self.cut(" ".join(group))
            pre += [p for p, _ in found]
            at = np.searchsorted(edges, [span[0] for _, span in found], "right") - 1
            owner += [part_owner[lo + i] for i in at]
        if pre:
            symbols, size = self.symbols(pre)
            ends = np.cumsum(size)
            short = size <= LONG
            tokens = np.zeros(len(pre), np.int64)
            tokens[short] = self.merge(symbols[np.repeat(short, size)], size[short])
            for k in np.flatnonzero(~short):
                tokens[k] = self.merge_long(symbols[ends[k] - size[k]:ends[k]])
            np.add.at(whole, np.array(owner), tokens)
        self.counts.update(zip(chunks, whole.tolist()))

    def count(self, texts: Iterable[str | None]) -> list[int]:
        """Number of tokens of each text."""
        if len(self.counts) > self.entries:
            self.counts.clear()
        cut = [CHUNK.findall(t) if t else [] for t in texts]
        new = list(set().union(*cut).difference(self.counts))
        if new:
            self._count_new(new)
        out = [sum(map(self.counts.__getitem__, chunks)) for chunks in cut]
        for chunk in new:
            if len(chunk) > CHUNK_CHARS:
                del self.counts[chunk]
        return out


@lru_cache(maxsize=1)
def table_of(path: str) -> MergeTable:
    """The table of a Python worker; its later tasks go on with it."""
    return MergeTable(path)


GROUP_CHARS = 1 << 22


def token_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """``df`` plus the long column ``out``: tokens of ``text`` under the BPE vocabulary at ``path``."""
    ship_package(df.sparkSession)
    path = path or default_vocabulary()

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        table = table_of(path)
        rows, group, size, made = texts.tolist(), [], 0, []
        for row in rows:        # groups of whole texts: the cut texts of a group are in memory at once
            group.append(row)
            size += len(row or "")
            if size >= GROUP_CHARS:
                made += table.count(group)
                group, size = [], 0
        made += table.count(group)
        return pd.Series(made, dtype="int64")

    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]
    return df.select(*kept, counted(F.col(f"`{text}`")).alias(out))


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    from ticketflow.llm.tables import table

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    counted = token_counts(docs)
    return counted.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
                          "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))
