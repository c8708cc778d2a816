"""Encoding of whole corpora with a public byte-level BPE vocabulary.

Forced-boundary splitting: a pair of bytes that no vocabulary token contains can never be merged across, so
a text may be cut there, its fragments encoded independently and the ids concatenated. Cuts are found over the
bytes of a whole batch at once; as fragments are mostly words, each distinct one is encoded once and looked up
afterwards. A cut must not change how the pre-tokenizer's pattern sees its sides either: cuts are made only
between two characters that are not white space, the second not an apostrophe unless after a letter or digit,
or before white space that follows another character.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from tidewater.session import c

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Distinct fragments a worker remembers, and the longest of them in bytes.
CACHE_ENTRIES, CACHE_BYTES = 400_000, 48
#: Bytes of text that are cut and encoded at once; a longer text is a batch of its own.
BATCH_BYTES = 4_000_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where this machine has the public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Exactly the ids of the plain encoder, special tokens being ordinary text."""

    def __init__(self, path: str, pattern: str | None = None):
        import tiktoken

        if pattern is None:
            from public_tokenizers import PATTERN as pattern  # noqa: N811
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        inside = np.zeros((256, 256), dtype=bool)
        for token in ranks:
            t = np.frombuffer(token, dtype=np.uint8)
            inside[t[:-1], t[1:]] = True
        self.never = ~inside
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Positions in UTF-8 bytes before which a boundary is certain."""
        if len(data) < 2:
            return np.empty(0, dtype=np.int64)
        a, b = data[:-1], data[1:]
        at = np.flatnonzero(self.never[a, b] & ((b & 0xC0) != 0x80)) + 1
        z = data[at - 1]
        y = np.where(at >= 2, data[np.maximum(at - 2, 0)], 0)
        x = np.where(at >= 3, data[np.maximum(at - 3, 0)], 0)
        low = (z == 32) | ((z >= 9) & (z <= 13)) | ((z >= 28) & (z <= 31))
        wide = ((y == 0xC2) & ((z == 0x85) | (z == 0xA0))) | (
            ((x == 0xE1) & (y == 0x9A) & (z == 0x80))
            | ((x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)))
            | ((x == 0xE2) & (y == 0x81) & (z == 0x9F))
            | ((x == 0xE3) & (y == 0x80) & (z == 0x80))
        )
        alnum = ((z >= 48) & (z <= 57)) | ((z >= 65) & (z <= 90)) | ((z >= 97) & (z <= 122))
        return at[~(low | wide) & ((data[at] != 39) | alnum)]

    def _ids(self, piece: bytes) -> tuple[int, ...]:
        ids = self.cache.get(piece)
        if ids is None:
            ids = tuple(self.plain.encode_ordinary(piece.decode()))
            if len(piece) <= CACHE_BYTES:
                if len(self.cache) >= CACHE_ENTRIES:
                    self.cache.clear()
                self.cache[piece] = ids
        return ids

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, pa.ListArray, pa.Array]:
        """Where each text's fragments begin and end, the ids of each distinct fragment, and which one each is."""
        blank = texts.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(blank.buffers()[1], dtype=np.int64)[blank.offset : blank.offset + len(blank) + 1]
        data = np.frombuffer(blank.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        ends = offsets - offsets[0]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[self.cuts(data)] = cut[ends] = True
        bounds = np.flatnonzero(cut)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        ids = pa.array([self._ids(x) for x in coded.dictionary.to_pylist()], pa.list_(pa.int32()))
        return np.searchsorted(bounds, ends), ids, coded.indices

    def encode_lists(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text."""
        ends, ids, which = self.encode_many(texts)
        each = ids.take(which)
        offsets = each.offsets.to_numpy()[ends]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each.values)

    def encode_sizes(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        ends, ids, which = self.encode_many(texts)
        sizes = np.diff(ids.offsets.to_numpy())[which.to_numpy()]
        return np.diff(np.concatenate(([0], np.cumsum(sizes)))[ends])

    def encode(self, text: str | None) -> list[int]:
        return self.encode_lists(pa.array([text], pa.string()))[0].as_py()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about BATCH_BYTES of text."""
    sizes = np.cumsum(pa.compute.binary_length(batch.column(1).cast(pa.large_string())).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(batch):
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + BATCH_BYTES, side="right")))
        yield batch.slice(start, end - start)
        start = end


def encode_column(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids array<int>) of every row, in its own partition: no shuffle.

    Null and empty texts give an empty list; every other text is encoded whole, however long.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path or vocabulary_path())  # found where the worker has it
        for whole in batches:
            for b in _slices(whole):
                yield pa.RecordBatch.from_arrays([b.column(0), enc.encode_lists(b.column(1))], ["k", "ids"])

    out = df.select(c(key).alias("k"), c(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>")
    return out.withColumnRenamed("k", key)


def count_column(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, n_tokens int) of every row; null and empty texts have none."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path or vocabulary_path())  # found where the worker has it
        for whole in batches:
            for b in _slices(whole):
                sizes = pa.array(enc.encode_sizes(b.column(1)), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), sizes], ["k", "n_tokens"])

    out = df.select(c(key).alias("k"), c(text).alias("t")).mapInArrow(run, f"k {kind}, n_tokens int")
    return out.withColumnRenamed("k", key)
