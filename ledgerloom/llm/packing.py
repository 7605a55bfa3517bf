"""Packing by power-of-two decomposition.

A document of ``n`` tokens is cut into pieces whose lengths are the powers of
two that add up to ``n`` (whole windows first, then the binary digits of the
rest, longest first). Every piece is a sequence of its own in the bucket of its
length: training batches are drawn from one bucket, so no sequence crosses a
document and none is padded.

Tokenizing is per word: the tokenizer's splitter never joins characters across
ASCII white space, so a word's ids are the same wherever it stands, and workers
keep the ids of words they have met in a bounded table.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import released, small_batches

WINDOW = 4096
PIECES = "doc_id {id}, start long, length long, doc_tokens long, bucket int, ids binary, offset long"


class WordIds(dict):
    """word -> its ids as little-endian unsigned 32-bit integers.

    At most ``2 * most`` words are kept: when ``most`` new ones have come, those
    of the round before that were not met again go.

    A word of Latin letters is one unit to the splitter, and so is a run of marks
    behind it: those go straight to the tokenizer's merge model. All other words
    go through the whole tokenizer.
    """

    MARKS = ".,;:!?#$%&*|"  # neither letters, digits, white space nor the apostrophe

    def __init__(self, path: str, most: int = 120_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.merge = self.tokenizer.model.tokenize
        self.letter = byte_letters()
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            packed = self.encoded(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = packed
        return packed

    def encoded(self, word: str) -> bytes:
        stem = word.rstrip(self.MARKS)
        if stem.isalpha() and max(stem) < "\u0100":
            if len(stem) < len(word):
                return self[stem] + self[word[len(stem) :]]
            unit = stem.lower()
            if not unit.isascii():
                unit = "".join([self.letter[b] for b in unit.encode()])
            return array("I", [t.id for t in self.merge(unit)]).tobytes()
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()


class TextIds:
    """The ids of a batch of texts: every distinct word of the batch is looked up once, the rest is array work."""

    def __init__(self, path: str, end_id: int):
        self.words, self.end_id = WordIds(path), end_id
        self.bits = max(self.words.tokenizer.get_vocab_size() - 1, end_id, 1).bit_length()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as little-endian unsigned 32-bit integers, each text followed by the end id; number of ids of each text)."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        each = [self.words[w] for w in coded.dictionary.to_pylist()]
        table, sizes = np.frombuffer(b"".join(each), "<u4"), np.array([len(e) // 4 for e in each], np.int64)
        at = coded.indices.to_numpy()
        n = sizes[at]
        upto = np.concatenate([[0], np.cumsum(n)])
        kind = np.int32 if max(upto[-1], len(table)) < 2**31 else np.int64
        places = np.repeat(((np.cumsum(sizes) - sizes)[at] - upto[:-1]).astype(kind), n)
        places += np.arange(upto[-1], dtype=kind)
        bounds = np.asarray(split.offsets)
        ends = upto[bounds - bounds[0]]
        return np.insert(table[places], ends[1:], self.end_id), np.diff(ends) + 1


@lru_cache(maxsize=1)
def text_ids(path: str, end_id: int) -> TextIds:
    """The encoder of this Python worker: its tokenizer and its bounded table of words serve all tasks that the worker runs."""
    return TextIds(path, end_id)


def portions(batch: pa.RecordBatch, column: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts have ``most`` bytes together, or are one row."""
    ends, low = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)), 0
    while low < batch.num_rows:
        begun = ends[low - 1] if low else 0
        high = max(int(np.searchsorted(ends, begun + most, side="right")), low + 1)
        yield batch.slice(low, high - low)
        low = high


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(0x100) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(others)}


def cuts(tokens: int, window: int = WINDOW) -> list[int]:
    """The lengths of a document's pieces, in order."""
    rest = tokens % window
    return [window] * (tokens // window) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def split_words(text: str) -> list[str]:
    """``text`` cut at ASCII white space, and nowhere else."""
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return text.split(" ")


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, bucket, ids, sequence_id, offset.

    ``ids`` are packed unsigned 32-bit integers, ``bucket`` is the base-2
    logarithm of ``length``. ``window`` must be a power of two. Null or empty
    text gives the one piece that holds ``end_id``; texts of any length are packed
    whole. Repeated rows are packed each for itself under the same doc_id; a null
    doc_id stays null. An empty table gives an empty result. Other columns are not read. ``tokenizer_path`` must name the same file on every
    executor. ``sequence_id`` is unique and depends only on how the input is
    partitioned, so a task that runs again gives the same ids.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_ids(tokenizer_path, end_id)
        for batch in (portion for whole in batches for portion in portions(whole, 1)):
            values, totals = encode(batch.column(1))
            held, begun = values.tobytes(), 0
            rows: list[list] = [[], [], [], [], [], []]
            for i, total in enumerate(totals.tolist()):
                start = 0
                for n in cuts(total, window):
                    at = 4 * (begun + start)
                    for column, value in zip(rows, (i, start, n, total, n.bit_length() - 1, held[at : at + 4 * n]), strict=True):
                        column.append(value)
                    start += n
                begun += total
            if rows[0]:
                yield _batch(batch.column(0), rows)

    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(pieces), PIECES.format(id=kind.simpleString()))
    return out.withColumn("sequence_id", F.monotonically_increasing_id())


def _batch(ids: pa.Array, rows: list[list]) -> pa.RecordBatch:
    i, start, n, total, bucket, data = rows
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
    columns = [ids.take(pa.array(i, pa.int64()))]
    columns += [pa.array(c, k) for c, k in zip((start, n, total, bucket, data, [0] * len(i)), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "bucket", "ids", "offset"])
