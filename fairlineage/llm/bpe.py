"""Byte-pair encoding and decoding of whole texts with a given word-end vocabulary.

Method: the symbols of a piece form a doubly linked list; a priority queue holds (merge rank, place)
of neighbouring pairs. The least entry is taken, skipped if it is stale (one of its symbols has been
merged away or has grown since), and otherwise merged, which puts up to two new pairs into the queue.
Decoding puts the vocabulary strings of the ids one after the other, with the separator that the
vocabulary file asks for (a blank, as this file names no decoder).

Pieces recur, so each Python worker remembers the ids of the pieces it has met, up to a bound, after
which it starts anew; the bound changes speed only. No shuffle, and a lost task is simply run again.

Defined results: null and empty text give no ids and an empty decoded text; repeated rows are all
kept; a text of any length is encoded whole; further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ..session import ship_package
from .common import slices

#: Fixed values of the vocabulary's own files: the pieces it merges within.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
REMEMBERED = 400_000


def byte_letters() -> list[str]:
    """A printable letter for each byte: printable Latin-1 bytes stand for themselves, others follow from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Pieces(dict):
    """Piece → its ids as 4-byte integers; works out what it has not met."""

    def __init__(self, codec: "WordBpe"):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = np.array(self.codec.piece_ids(piece), dtype="<i4").tobytes()
        self[piece] = ids
        return ids


class WordBpe:
    """One vocabulary file, loaded once per Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges[vocab[a], vocab[b]] = rank, vocab[a + b]
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + WORD_END] for c in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for text, i in (*vocab.items(), *self.special.items()):
            self.strings[i] = text
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.find = regex.compile(PIECES).findall
        self.pieces = Pieces(self)

    def piece_ids(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in data]
        ids[-1] = self.final[data[-1]]
        n = len(ids)
        if n == 1:
            return ids
        merges = self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(m[0], i, m[1]) for i, pair in enumerate(zip(ids, ids[1:])) if (m := merges.get(pair))]
        heapq.heapify(queue)
        while queue:
            rank, i, made = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n or (m := merges.get((ids[i], ids[j]))) is None or m[0] != rank:
                continue  # stale
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((made, ids[k])):
                    heapq.heappush(queue, (m[0], i, m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((ids[h], made))):
                heapq.heappush(queue, (m[0], h, m[1]))
        return [i for i in ids if i >= 0]

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens: composed, letters made small one by one, cut into pieces."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        pieces = self.pieces
        return b"".join([pieces[p] for p in self.find(text.lower())])

    def encode(self, text: str) -> np.ndarray:
        if self.split_special is None or not self.split_special.search(text):
            data = self._plain(text)
        else:
            data = b"".join(
                np.array([self.special[part]], dtype="<i4").tobytes() if i % 2 else self._plain(part)
                for i, part in enumerate(self.split_special.split(text)))
        return np.frombuffer(data, dtype="<i4")

    def decode(self, ids) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in ids])


_loaded: dict[str, WordBpe] = {}


def codec(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, decoded string) of every row: ids of the whole text and the text of these ids."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in slices(batches):
            ids = [c.encode(t) for t in part.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.empty(0, "<i4"), type=pa.int32())
            decoded = pa.array([c.decode(i.tolist()) for i in ids], type=pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat), decoded], ["key", "ids", "decoded"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(work, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of encoded rows."""
    return encoded.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
