"""Secret scans: fixed patterns plus a token-efficiency test for random strings.

Base kinds (patterns are fixed by the contract of the scan): ``assign``,
``access`` and ``hex``.  The method adds kind ``random``: a run of key
characters of at least ``min_chars`` with a letter whose characters per token
under a public byte-level vocabulary are below ``max_ratio``; in a run without
a digit separators count neither as characters nor as tokens, so words joined
by them stay words, and a written-out alphabet is none.  Prose and identifiers made of words take few tokens; random
strings take many.  Known digests (hexadecimal of a digest's length) and
identifiers (UUIDs, numbers with separators, dates) are excluded first.  A
random run inside a base span is not reported again.

Each text is scanned alone, whole and without a shuffle; Python's regular
expressions run only on texts in which a byte-level test found a keyword or a
long enough run.  A null text counts as empty and has no spans; repeated rows
give repeated results.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.llm.blocks import text_blocks

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32

KEY_RUN = "[A-Za-z0-9+/_=-]"
DIGEST_LENGTHS = frozenset({32, 40, 48, 56, 64, 96, 128})
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")
WITHOUT_LETTER = re.compile(r"[^A-Za-z]+")
WITHOUT_DIGIT = re.compile(r"[^0-9]+")
LETTERS = re.compile(r"[A-Za-z]+")

IS_HEX = np.zeros(256, bool)
IS_HEX[[*b"0123456789abcdef"]] = True
IS_KEY = np.zeros(256, bool)
IS_KEY[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"]] = True


@dataclass(frozen=True)
class RandomRules:
    min_chars: int = 20
    max_ratio: float = 2.2   # characters per token


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def vocabulary(path: str):
    """tiktoken encoding of a rank file (once per Python worker)."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_random(run: str, rules: RandomRules, encoding) -> bool:
    """Token-efficiency test of one run of key characters."""
    if WITHOUT_LETTER.fullmatch(run):
        return False
    if (len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run)) or UUID.fullmatch(run):
        return False
    if WITHOUT_DIGIT.fullmatch(run):
        if 4 * sum(ord(b) - ord(a) == 1 for a, b in zip(run, run[1:])) >= 3 * (len(run) - 1):   # an alphabet
            return False
        parts = LETTERS.findall(run)
        return sum(map(len, parts)) < rules.max_ratio * sum(len(encoding.encode_ordinary(x)) for x in parts)
    return len(run) < rules.max_ratio * len(encoding.encode_ordinary(run))


def _long_run_texts(block, allowed: np.ndarray, least: int) -> np.ndarray:
    """Texts of a block that may hold a run of >= ``least`` allowed bytes (runs
    may only be overstated, where two texts meet)."""
    mask = np.zeros(len(block.data) + 2, bool)
    mask[1:-1] = allowed[block.data]
    change = np.flatnonzero(mask[1:] != mask[:-1])
    start, end = change[::2], change[1::2]
    long = end - start >= least
    found = np.zeros(block.hi - block.lo + 1, np.int64)
    for s, e in zip(start[long], end[long]):
        a = np.searchsorted(block.edges, s, "right") - 1
        b = np.searchsorted(block.edges, e, "left") - 1
        found[a:b + 1] = 1
    return found[:-1].astype(bool)


def find_spans(text: str, rules: RandomRules, encoding, hexes: bool = True, runs: bool = True
               ) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of every span of one text, sorted."""
    spans = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    if hexes:
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if runs:
        base = sorted(spans)
        for m in re.finditer(f"{KEY_RUN}{{{rules.min_chars},}}", text):
            if not any(s <= m.start() and m.end() <= e for s, _, e in base) and is_random(m[0], rules, encoding):
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def scan(column: pa.Array, rules: RandomRules, ranks: str) -> list[list[tuple[int, int, int]]]:
    """Spans of every text of a column, in row order."""
    encoding = vocabulary(ranks)
    out = []
    for block in text_blocks(column):
        hexes = _long_run_texts(block, IS_HEX, HEX_CHARS)
        runs = _long_run_texts(block, IS_KEY, rules.min_chars)
        texts = column.slice(block.lo, block.hi - block.lo).to_pylist()
        out += [find_spans(t or "", rules, encoding, h, r) for t, h, r in zip(texts, hexes, runs)]
    return out


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for s, _, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def secret_spans(df: DataFrame, text: str = "text", rules: RandomRules = RandomRules(),
                 ranks: str | None = None, redact: str | None = None) -> DataFrame:
    """``df`` with a struct column ``secrets``.

    Fields: ``spans`` (array of kind, start, end), ``span_list`` (the same as
    ``kind:start:end`` joined by commas), ``base_list`` (base kinds only) and,
    with ``redact``, ``text`` (the text with every span replaced by it).  An
    input column named ``secrets`` is replaced.
    """
    path = ranks or default_ranks()
    schema = ("spans array<struct<kind:string,start:long,end:long>>, span_list string, base_list string"
              + (", text string" if redact is not None else ""))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf(schema)
    def scanned(texts: pa.Array) -> pa.Array:
        found = scan(texts, rules, path)
        out = {
            "spans": pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in found], span),
            "span_list": pa.array([span_text(x) for x in found], pa.string()),
            "base_list": pa.array([span_text([y for y in x if y[1] < 3]) for x in found], pa.string()),
        }
        if redact is not None:
            out["text"] = pa.array([t if t is None or not x else _redacted(t, x, redact)
                                    for t, x in zip(texts.to_pylist(), found)], pa.string())
        return pa.StructArray.from_arrays(list(out.values()), names=list(out))

    columns = [F.col(f"`{c}`") for c in df.columns if c.lower() != "secrets"]
    return df.select(*columns, scanned(F.col(text)).alias("secrets"))



def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    from ticketflow.llm.tables import table

    s = secret_spans(table(spark, sf_dir, "documents", "doc_id", "text"))
    kind = lambda k: F.size(F.filter("secrets.spans", lambda x: x["kind"] == k)).cast("long")
    return s.select("doc_id", kind("assign").alias("n_assign"), kind("access").alias("n_access"),
                    kind("hex").alias("n_hex"), F.sha2(F.col("secrets.base_list"), 256).alias("base_sha256"),
                    F.col("secrets.span_list").alias("spans"))
