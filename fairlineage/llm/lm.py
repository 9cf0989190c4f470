"""Scores of texts under an interpolated bigram model, learned from the corpus.

Method (deleted interpolation). The probability of a word w after v mixes maximum-likelihood estimates,
l2 * c(v,w)/c(v) + l1 * c(w)/N + l0 / (V+1), with weights that depend on how frequent the context v is (a bucket
per power of two). Part of the training texts is held out: with counts from the others, the weights are learned by
expectation-maximisation on the held-out words. Scores use the weights with the counts of all training texts.

How it is spread. Texts become chunks of about ``CHUNK`` words, stored as numbers of a chunk's own word list. A chunk
asks for the counts of its distinct words and word pairs, and adds its own; questions are dealt by hash over buckets whose number
grows with the corpus, a bucket sums each key over all chunks, and answers each chunk in the order it
asked. So a very frequent word costs a row per chunk, never a row per occurrence, and neither counts nor texts pass
through one place. Held-out chunks return a table of (context bucket, steps of both estimates, words) of
bounded size, from which the driver learns the weights. Chunks are written once, tasks that are lost are run again.

Words are compared by 64-bit hashes; A-Z are made small; every text ends with one end token and is preceded by a
begin context, whose count is that of ends. Defined results: null and empty texts consist of the end token; a null key
is in training; repeated rows count, and are scored, each; texts of any length are scored whole; without training texts
all counts are 0 and only the last term is left; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import cut, ship_package
from .common import mixed, pack, slices, unpack

#: Words of a chunk and questions of a bucket: division of work only.
CHUNK, BUCKET = 1_500_000, 1_500_000
#: Steps per power of two in which estimates are told apart while weights are learned.
STEPS = 4
END = b"\n"
class WordList(dict):
    """Word → its number in a chunk."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def make_chunks(docs: DataFrame, folds: int, held_out: int, deleted: int, key: str, text: str) -> DataFrame:
    """(chunk, keys, deleted, sizes, folds, words, tokens): texts as numbers, in chunks of one kind."""
    ship_package(docs.sparkSession)
    rows = docs.select(
        F.struct(F.col(key).alias("key")).alias("row"),
        F.coalesce(F.crc32(F.col(key).cast("string")) % folds, F.lit(-1)).cast("int").alias("fold"),
        F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    kind = rows.schema["row"].dataType
    names = ["chunk", "rows", "deleted", "sizes", "folds", "words", "tokens", "n"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0

        def finish(o: dict) -> pa.RecordBatch:
            nonlocal made
            tokens = np.concatenate(o["tokens"])
            of = np.bincount(tokens, minlength=len(o["list"]))
            order = np.argsort(-of, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            words = np.fromiter(map(xxhash.xxh3_64_intdigest, o["list"]), np.uint64, len(order))[order]
            chunk = (TaskContext.get().partitionId() << 32) + made
            made += 1
            rows_ = pa.concat_arrays(o["rows"])
            return pa.RecordBatch.from_arrays([
                pa.array([chunk], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(rows_)], pa.int32()), rows_),
                pa.array([o["deleted"]]), pa.array([pack(np.array(o["sizes"]))]), pa.array([pack(np.array(o["folds"]) + 1)]),
                pa.array([words.tobytes()], pa.binary()), pa.array([pack(place[tokens])]), pa.array([len(tokens)], pa.int64()),
            ], names)

        def fresh(is_deleted: bool) -> dict:
            return {"deleted": is_deleted, "list": WordList(), "rows": [], "sizes": [], "folds": [], "tokens": [], "n": 0}

        open_ = {False: fresh(False), True: fresh(True)}
        for part in slices(batches, 256):
            fold = part.column(1).to_pylist()
            for is_deleted in (False, True):
                mine = [i for i, f in enumerate(fold) if (f == deleted) == is_deleted]
                if not mine:
                    continue
                o = open_[is_deleted]
                sub = part.take(pa.array(mine))
                o["rows"].append(sub.column(0))
                for i, t in zip(mine, sub.column(2).to_pylist()):
                    words = t.lower().split()
                    words.append(END)
                    o["tokens"].append(np.fromiter(map(o["list"].__getitem__, words), np.int64, len(words)).astype(np.int32))
                    o["sizes"].append(len(words))
                    o["folds"].append(fold[i])
                    o["n"] += len(words)
                if o["n"] >= CHUNK:
                    yield finish(o)
                    open_[is_deleted] = fresh(is_deleted)
        for o in open_.values():
            if o["n"]:
                yield finish(o)

    return rows.mapInArrow(work, f"chunk long, rows array<{kind.simpleString()}>, deleted boolean, sizes binary, "
                           "folds binary, words binary, tokens binary, n long")


class Chunk:
    """A chunk's tokens, their contexts, and its distinct words and pairs in the order in which it asks for them."""

    def __init__(self, row: dict, held_out: int, deleted: int):
        self.words = np.frombuffer(row["words"], "<u8")
        self.tokens = unpack(row["tokens"]).astype(np.int64)
        self.sizes = unpack(row["sizes"]).astype(np.int64)
        folds = unpack(row["folds"]).astype(np.int64) - 1
        n = len(self.words)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.context = np.empty_like(self.tokens)
        self.context[1:] = self.tokens[:-1]
        self.context[self.starts] = n
        learns, dev = folds != held_out, folds == deleted
        self.held_out = ~learns
        token_learns, token_dev = np.repeat(learns, self.sizes), np.repeat(dev, self.sizes)
        self.end = int(self.tokens[-1])
        pairs, self.pair_of = np.unique(self.context * (n + 1) + self.tokens, return_inverse=True)
        left = np.append(self.words, np.uint64(1))[pairs // (n + 1)]
        pair_keys = mixed(mixed(left) * np.uint64(3) + self.words[pairs % (n + 1)])
        self.asked = []
        for keys, of in ((mixed(self.words), self.tokens), (pair_keys, self.pair_of)):
            order = np.argsort(keys, kind="stable")
            learned = np.bincount(of[token_learns], minlength=len(keys))
            held = np.bincount(of[token_dev], minlength=len(keys))
            self.asked.append((keys[order], learned[order], held[order], order))

    def answer(self, kind: int, answers: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Corpus counts of all training texts and of the deleted part, by word number or by pair number."""
        keys, _, _, order = self.asked[kind]
        out = []
        for column in (1, 2):
            values = np.empty(len(keys), np.int64)
            values[order] = np.concatenate([unpack(a[column]) for a in sorted(answers)]).astype(np.int64)
            out.append(values)
        return out[0], out[1]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of sorted keys, in order."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def ask(chunks: DataFrame, buckets: int, held_out: int, deleted: int) -> DataFrame:
    """(kind, bucket, chunk, keys, learned, held): what every chunk asks each bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            row = part.to_pylist()[0]
            c = Chunk(row, held_out, deleted)
            for kind, (keys, learned, held, _) in enumerate(c.asked):
                of = _bucket(keys, buckets)
                cuts = np.flatnonzero(np.diff(of, prepend=-1))
                rows = []
                for a, b in zip(cuts, [*cuts[1:], len(keys)]):
                    rows.append((kind, int(of[a]), row["chunk"], pack(np.diff(keys[a:b], prepend=np.uint64(0))),
                                 pack(learned[a:b]), pack(held[a:b])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in zip(*rows)], ["kind", "bucket", "chunk", "keys", "learned", "held"])

    return chunks.select("chunk", "sizes", "folds", "words", "tokens").mapInArrow(
        work, "kind long, bucket long, chunk long, keys binary, learned binary, held binary")


def answer(asked: DataFrame) -> DataFrame:
    """(chunk, kind, bucket, learned, held): each chunk's answers; chunk -1 has sums over a bucket's distinct keys in ``sums``."""

    def work(table: pa.Table) -> pa.Table:
        kind, bucket = table["kind"][0].as_py(), table["bucket"][0].as_py()
        keys = [np.cumsum(unpack(k), dtype=np.uint64) for k in table["keys"].to_pylist()]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = []
        for name in ("learned", "held"):
            own = np.concatenate([unpack(x) for x in table[name].to_pylist()])
            totals.append(np.bincount(place, weights=own.astype(np.float64)).astype(np.int64))
        learned, held = totals
        ends = np.cumsum([0, *map(len, keys)])
        at = [place[a:b] for a, b in zip(ends, ends[1:])]
        sums = [int(learned.sum()), int((learned > 0).sum()), int((learned - held).sum()), int((learned > held).sum())]
        n = len(at)
        return pa.table({
            "chunk": pa.array([*table["chunk"].to_pylist(), -1], pa.int64()),
            "kind": pa.array([kind] * (n + 1), pa.int64()), "bucket": pa.array([bucket] * (n + 1), pa.int64()),
            "learned": pa.array([pack(learned[p]) for p in at] + [None], pa.binary()),
            "held": pa.array([pack(held[p]) for p in at] + [None], pa.binary()),
            "sums": pa.array([None] * n + [sums], pa.list_(pa.int64()))})

    return asked.groupBy("kind", "bucket").applyInArrow(
        work, "chunk long, kind long, bucket long, learned binary, held binary, sums array<long>")


def frequency_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + the power of two below its count."""
    return np.where(counts > 0, 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64), 0)


def _counts(left: pa.Table, right: pa.Table, held_out: int, deleted: int) -> tuple[dict, Chunk, list]:
    row = left.to_pylist()[0]
    c = Chunk(row, held_out, deleted)
    parts = list(zip(right["kind"].to_pylist(), right["bucket"].to_pylist(), right["learned"].to_pylist(),
                     right["held"].to_pylist()))
    return row, c, [c.answer(kind, [p[1:] for p in parts if p[0] == kind]) for kind in (0, 1)]


def held_out_table(chunks: DataFrame, answers: DataFrame, words: int, held_out: int, deleted: int) -> DataFrame:
    """(bucket, two, one, n): held-out words by context bucket and steps of their pair and word estimates (-1: none)."""

    def steps(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.round(-STEPS * np.log2(np.maximum(p, 1e-300))).astype(np.int64), -1)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {n: pa.array([], pa.int64()) for n in ("bucket", "two", "one", "n")}
        if not left.num_rows or not right.num_rows:
            return pa.table(empty)
        _, c, ((word, word_held), (pair, pair_held)) = _counts(left, right, held_out, deleted)
        word, pair = word - word_held, pair - pair_held
        before = np.append(word, word[c.end])[c.context]
        two = np.where(before > 0, pair[c.pair_of] / np.maximum(before, 1), 0.0)
        one = word[c.tokens] / max(words, 1)
        table = np.stack([frequency_bucket(before), steps(two), steps(one)])
        kinds, n = np.unique(table, axis=1, return_counts=True)
        return pa.table({"bucket": kinds[0], "two": kinds[1], "one": kinds[2], "n": n.astype(np.int64)})

    return (
        chunks.where("deleted").select("chunk", "sizes", "folds", "words", "tokens").groupBy("chunk")
        .cogroup(answers.where("chunk >= 0").groupBy("chunk"))
        .applyInArrow(work, "bucket long, two long, one long, n long")
        .groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")))


def learn_weights(rows: list, types: int, rounds: int = 60) -> np.ndarray:
    """Weights (l2, l1, l0) of every context bucket by expectation-maximisation; row 0 is for unseen contexts."""
    weights = np.tile(np.array([0.3, 0.5, 0.2]), (66, 1))
    weights[0] = (0.0, 0.7, 0.3)
    by = np.array([tuple(r) for r in rows], dtype=np.float64).reshape(-1, 4)
    from_steps = lambda s: np.where(s < 0, 0.0, np.exp2(-s / STEPS))
    parts = np.stack([from_steps(by[:, 1]), from_steps(by[:, 2]), np.full(len(by), 1 / (types + 1))], axis=1)
    bucket, n = by[:, 0].astype(int), by[:, 3]
    for _ in range(rounds if len(by) else 0):
        share = weights[bucket] * parts
        share *= (n / np.maximum(share.sum(1), 1e-300))[:, None]
        # a small prior keeps every weight above 0 and settles buckets without held-out words
        new = np.stack([np.bincount(bucket, weights=share[:, i], minlength=66) for i in range(3)], axis=1) + [0.3, 0.5, 0.2]
        new[0, 0] = 0.0
        weights = new / new.sum(1, keepdims=True)
    return weights


def lm_scores(docs: DataFrame, folds: int = 7, held_out: int = 2, deleted: int = 3, key: str = "doc_id",
              text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Texts whose crc32(key as text) mod ``folds`` is ``held_out`` are not learned from; those of fold ``deleted`` are the
    part held out while weights are learned. ``base_score`` is the add-one unigram score in log10.
    """
    chunks, seen = cut(make_chunks(docs, folds, held_out, deleted, key, text), words=F.coalesce(F.sum("n"), F.lit(0)))
    answers = cut(answer(ask(chunks, max(1, seen["words"] // BUCKET), held_out, deleted)))
    sums = answers.where("chunk = -1 AND kind = 0").agg(
        *[F.coalesce(F.sum(F.col("sums")[i]), F.lit(0)).alias(str(i)) for i in range(4)]).first()
    tokens, types, main_tokens, main_types = (int(x) for x in sums)
    weights = learn_weights(held_out_table(chunks, answers, main_tokens, held_out, deleted).collect(), main_types)
    kind = chunks.schema["rows"].dataType.elementType.simpleString()

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        row, c, ((word, _), (pair, _)) = _counts(left.drop_columns(["rows"]), right, held_out, deleted)
        before = np.append(word, word[c.end])[c.context]
        own = word[c.tokens]
        w = weights[frequency_bucket(before)]
        two = np.where(before > 0, pair[c.pair_of] / np.maximum(before, 1), 0.0)
        p = w[:, 0] * two + w[:, 1] * own / max(tokens, 1) + w[:, 2] / (types + 1)
        sums = lambda x: np.add.reduceat(x, c.starts)
        return pa.table({
            "row": left["rows"].combine_chunks().flatten(), "held_out": pa.array(c.held_out),
            "n_tokens": c.sizes, "n_known": sums((own > 0).astype(np.int64)),
            "train_tokens": np.full(len(c.sizes), tokens, np.int64),
            "base_score": sums(np.log10((own + 1) / (tokens + types + 1))), "score": sums(np.log10(p))})

    scored = (
        chunks.select("chunk", "rows", "sizes", "folds", "words", "tokens").groupBy("chunk")
        .cogroup(answers.where("chunk >= 0").groupBy("chunk"))
        .applyInArrow(work, f"row {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                      "base_score double, score double"))
    return scored.select(F.col("row.key").alias(key), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
