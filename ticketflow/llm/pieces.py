"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary has a whitespace marker after another character
(checked when the model is loaded), so no merge crosses the place where a
marker follows a non-marker.  A text is therefore cut into marked words
(a run of markers and the characters after it); each distinct marked word is
segmented once per worker with the sentencepiece library, and a text's ids are
its marked words' ids joined back by position.

The table of distinct chunks belongs to one Python worker and is bounded
(``TABLE_ENTRIES`` chunks of at most ``CHUNK_CHARS`` characters; then it
starts anew; longer chunks are segmented each time they occur), so there is no shuffle
and a lost executor only repeats its own tasks.  A worker that goes on with another
operator drops the table (``blocks.worker_of``).

Defined results: a null text counts as empty; an empty text has the end id
alone and decodes to ''; repeated rows give repeated results; other columns
of the input are kept only if named in ``keep``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketflow.llm.blocks import worker_of

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
TABLE_ENTRIES = 400_000
CHUNK_CHARS = 64
GROUP_CHARS = 1 << 21


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkTable:
    """Distinct marked words of one task with their ids and decoded text."""

    def __init__(self, model_path: str, entries: int = TABLE_ENTRIES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses a whitespace marker: chunks are not independent")
        # the chunks take for granted that a marker is put before the text and
        # that nothing else is rewritten; ask the library, do not assume
        if self.model.normalize("x   ﬁ  y") != f"{MARK}x{MARK} {MARK}ﬁ{MARK}{MARK}y":
            raise ValueError("the model rewrites text before it cuts it: chunks would differ")
        self.end = self.model.eos_id()
        self.mark = self.model.piece_to_id(MARK)
        self.entries = entries
        self.ids: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}   # decoded text of chunks that do not decode to themselves

    def _segment(self, chunks: list[str]) -> None:
        # the library puts one marker before a text, so a chunk is passed
        # without its first one; the lone marker has no text left to pass
        for chunk, ids in zip(chunks, self.model.encode([c[1:] for c in chunks], num_threads=1)):
            if chunk == MARK:
                ids = [self.mark]
            self.ids[chunk] = " ".join(map(str, ids)).encode()
            # a leading marker keeps the library from dropping the chunk's own space
            text = self.model.decode([self.mark, *ids])
            if text != chunk.replace(MARK, " "):
                self.odd[chunk] = text

    def lookup(self, texts: list[str]) -> list[list[str]]:
        """Chunks of each text; afterwards the table holds all of them."""
        if len(self.ids) > self.entries:
            self.ids.clear()
            self.odd.clear()
        cut = [CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = {c for chunks in cut for c in chunks if c not in self.ids}
        if new:
            self._segment(list(new))
        return cut

    def forget_long(self, cut: list[list[str]]) -> None:
        for chunks in cut:
            for c in chunks:
                if len(c) > CHUNK_CHARS:
                    self.ids.pop(c, None)
                    self.odd.pop(c, None)

    def encode(self, chunks: list[str]) -> bytes:
        """Decimal ids joined by one space, the end id last."""
        return b" ".join([*map(self.ids.__getitem__, chunks), b"%d" % self.end])

    def decode(self, chunks: list[str]) -> str:
        # the marker before the first chunk is the library's own and is dropped
        if self.odd and not self.odd.keys().isdisjoint(chunks):
            chunks = [self.odd.get(c, c.replace(MARK, " ")) for c in chunks]
        return "".join(chunks).replace(MARK, " ")[1:]


@lru_cache(maxsize=1)
def table_of(model_path: str) -> ChunkTable:
    """The table of a Python worker; its later tasks go on with it."""
    return ChunkTable(model_path)


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about GROUP_CHARS characters."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= GROUP_CHARS:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode_texts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 model_path: str | None = None, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encode ``text`` with an end id and decode it again.

    ``outputs`` names what is returned beside ``keep``: ``n_tokens`` (long),
    ``ids`` (array<int>), ``decoded`` (string), ``ids_sha256`` and
    ``decoded_sha256`` (lowercase hex digests of the decimal ids joined by one
    space and of the decoded text in UTF-8).  An output takes the place of a
    kept column of its name.
    """
    path = model_path or default_model()
    kinds = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(),
             "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    keep = tuple(k for k in keep if k.lower() not in outputs)
    arrow = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(),
             "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    source = df.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*source.select(*keep).schema.fields, *(T.StructField(o, kinds[o]) for o in outputs)])

    def run(batches):
        worker_of("pieces", table_of.cache_clear)
        table = table_of(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            for lo, hi in _groups(texts):
                cut = table.lookup(texts[lo:hi])
                made: dict[str, list] = {o: [] for o in outputs}
                for chunks in cut:
                    ids = table.encode(chunks)
                    back = table.decode(chunks) if {"decoded", "decoded_sha256"} & set(outputs) else ""
                    for o in outputs:
                        made[o].append(
                            ids.count(b" ") + 1 if o == "n_tokens"
                            else list(map(int, ids.split())) if o == "ids"
                            else back if o == "decoded"
                            else hashlib.sha256(ids if o == "ids_sha256" else back.encode()).hexdigest())
                table.forget_long(cut)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo) for i in range(len(keep))),
                     *(pa.array(made[o], arrow[o]) for o in outputs)], names=[*keep, *outputs])

    return source.mapInArrow(run, schema)


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    from ticketflow.llm.tables import table

    return encode_texts(table(spark, sf_dir, "documents", "doc_id", "text"),
                        outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
