"""Joining documents whose shingle sets are nearly equal, and the groups that such links form.

Method. A document's distinct shingles are the tokens of its set. Tokens are hashed into groups, and the
group counts are a point. Two sets that share o of their a and b tokens differ by a + b - 2o in the sum of
coordinate differences at least, so points of similar sets lie close together, and the sum of coordinate
minima bounds o from above. The index over these points is laid out for a shuffle:

* The top level splits by the total of the coordinates (the set's size) into size classes. A set also
  enters the class above if its partner may be there.
* Below, a class cuts its coordinates into segments. Similar sets differ in fewer tokens than a class has segments, so
  many segments have equal coordinates in both: each (class, segment, its coordinates) is a box, and similar
  points share one of their fuller boxes. Boxes with one point are leaves without partners and go.
* Points that share a box meet there by their sizes and by the parities of their coordinates: two sets differ in at least as many
  tokens as their parities differ in groups. Only pairs that pass both, and connect something new, leave the box.
* Points joined so are compared: leaves of a few points with their bounding boxes
  first, then points by their summed coordinate minima. Points that pass form families, and
  in these the surviving pairs are verified by their sets.

Both comparisons cut large groups into blocks of bounded size, of which only those whose sizes allow a link meet. One
R-tree over all points does not prune here (in tens of dimensions boxes of unlike sets overlap), so equal segments take the
place of its upper nodes; the leaves, their boxes and the bounds are the R-tree's.

Sets that are equal are one point from the start, so groups of copies are never expanded into pairs. In a
block only links that connect something new are emitted. Links are exact: no bound loses a pair.
Shingles are compared by 64-bit hashes.

Defined results: null text, or a text without words, has an empty set and is linked with nothing; fewer words than a
shingle make one token of the whole sequence; a null key is kept and ranks last when a
component's smallest key is chosen; rows that repeat are one point and each is returned; further columns are ignored, or
carried by ``one_per_group``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import cut, ship_package
from .common import components, mixed, pack, slices, small_side, unpack

#: Groups of a segment; a class's largest set over its smallest.
GROUPS, STEP = 1 << 40, 1.25
#: Most documents and most tokens of one side of a block, and points of a leaf: division of work only.
BLOCK_ROWS, BLOCK_TOKENS, LEAF = 1024, 2_000_000, 16
#: Rows of a slice, boxes of a bucket, and points of a box that are compared where they meet, a fuller box being left to blocks:
#: division of work only.
SLICE, BUCKET, FULL = 4096, 1_000_000, 2048
#: Bytes of parities, least and most; salts of a group of equal sets.
PARITIES, SALTS = (16, 128), 64

class WordHashes(dict):
    """Word → 64-bit hash; starts anew when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes, words_each: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text (A-Z made small)."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(words_each, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mixed(out + h[i:i + n])
    return np.unique(out)


def class_bounds(percent: int) -> list[int]:
    """Smallest set size of each class; below the first, similar sets are equal."""
    first = percent // (100 - percent)
    bounds = [max(1, first)]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * STEP)))
    return bounds


def boxes(tokens: np.ndarray, bounds: Sequence[int], percent: int) -> tuple[int, list[np.ndarray]]:
    """The set's class, and the boxes of its point there and in the class above, as 64-bit hashes of (class, segment, coordinates).

    Of a class's segments at most ``most`` differ between similar sets, so more than ``spare`` are equal. A set leaves out
    its ``spare`` segments with the fewest tokens, which say least, and keeps ties; of the equal segments,
    which have the same numbers of tokens in both, one is then kept by both.
    """
    n = len(tokens)
    own = int(np.searchsorted(bounds, n, side="right")) - 1
    out: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64)]
    if own < 0:
        return own, out
    for above, level in enumerate((own, own + 1)):
        if level > own and 100 * n < percent * bounds[level]:
            break
        most = (bounds[level + 1] - 1) * (100 - percent) // percent
        spare = max(3, (most + 1) // 3)
        segments = most + 1 + spare
        spread = mixed(tokens + np.uint64(level + 1))
        segment = ((spread >> np.uint64(32)) % np.uint64(segments)).astype(np.int64)
        group = mixed((spread & np.uint64(GROUPS - 1)) + np.uint64(1))
        size = np.bincount(segment, minlength=segments)
        sums = np.zeros(segments, np.uint64)
        np.add.at(sums, segment, group)
        kept = np.flatnonzero(size >= np.partition(size, spare)[spare])
        out[above] = mixed(sums[kept] + mixed(kept.astype(np.uint64) + np.uint64(level << 40))).view(np.int64)
    return own, out


def parity_bytes(level: int, bounds: Sequence[int]) -> int:
    """Bytes of a class's parities: a power of two, about a group for every two tokens, within bounds."""
    wide = PARITIES[0]
    while wide < PARITIES[1] and wide * 16 < bounds[level + 1]:
        wide *= 2
    return wide


def parities(tokens: np.ndarray, wide: int) -> bytes:
    """The group counts of a set modulo 2, a bit each. Halves folded onto each other are the parities at half the width."""
    bits = np.bincount((mixed(tokens + np.uint64(7)) % np.uint64(8 * wide)).astype(np.int64), minlength=8 * wide) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def point_of(tokens: np.ndarray) -> bytes:
    """Group counts of a set, a byte each: a power of two of groups, about four tokens in each.

    No bytes stand for a point that is not known (a count beyond a byte): it passes every bound.
    """
    dims = 16
    while dims * 4 < len(tokens):
        dims *= 2
    counts = np.bincount((mixed(tokens + np.uint64(99)) % np.uint64(dims)).astype(np.int64), minlength=dims)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def index_points(docs: DataFrame, carried: Sequence[str], words_each: int, percent: int, text: str) -> DataFrame:
    """(row struct, n, print, point, level, boxes, above, parities) of every row: set size, 128-bit print of the set, its point, its
    class and boxes there and in the class above, and its parities at that class's width."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"),
                       F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    bounds = class_bounds(percent)

    def lists(arrays: list[np.ndarray]) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches, 512):
            sets = [shingle_set(t, words_each, hashes) for t in part.column(1).to_pylist()]
            found = [boxes(s, bounds, percent) for s in sets]
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([point_of(s) for s in sets], pa.binary()),
                pa.array([level for level, _ in found], pa.int32()),
                lists([own for _, (own, _) in found]), lists([above for _, (_, above) in found]),
                pa.array([parities(s, parity_bytes(level + 1, bounds)) if level >= 0 else b"" for s, (level, _) in zip(sets, found)],
                         pa.binary()),
            ], ["row", "n", "print", "point", "level", "boxes", "above", "parities"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(work, f"row {kind}, n long, print binary, point binary, level int, boxes array<long>, above array<long>, "
                                 "parities binary")


def compared(ids: np.ndarray, sides: np.ndarray, size: np.ndarray, points: np.ndarray, percent: int,
             verified: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Pairs of a block that pass the bounds and ``verified`` and connect something new; with two sides, only pairs from both.

    Rows are in the order of ``size``. Leaves of a few points come first, by the bounding box of their points, then
    the points of the leaves that are left, both by the sum of coordinate minima.
    """
    leaf_box = np.maximum.reduceat(points, np.arange(0, len(size), LEAF))
    two_sides = sides.min() != sides.max()
    root = list(range(len(size)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i in range(len(size)):
        # the partner is as large or larger; o * (100 + percent) >= percent * (a + b) is the wanted similarity
        end = int(np.searchsorted(size, size[i] * 100 // percent, side="right"))
        if end <= i + 1:
            continue
        least = -(-percent * (size[i] + size[i:end]) // (100 + percent))
        first_leaf, last_leaf = (i + 1) // LEAF, (end - 1) // LEAF
        bound = np.minimum(leaf_box[first_leaf:last_leaf + 1], points[i]).sum(1, dtype=np.int64)
        for leaf in first_leaf + np.flatnonzero(bound >= least[0]):
            a, b = max(i + 1, leaf * LEAF), min(end, (leaf + 1) * LEAF)
            near = np.minimum(points[a:b], points[i]).sum(1, dtype=np.int64) >= least[a - i:b - i]
            for j in (a + np.flatnonzero(near)).tolist():
                if two_sides and sides[i] == sides[j]:
                    continue
                x, y = find(i), find(j)
                if x != y and verified(i, j):
                    root[x] = y
                    links.append((int(ids[i]), int(ids[j])))
    return links


def bound_links(ids: np.ndarray, sides: np.ndarray, size: np.ndarray, points: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Pairs that the bound on their points lets pass, as far as they connect something new."""
    order = np.lexsort((ids, size))
    known = [len(p) for p in points if p]
    dims = min(known, default=16)
    folded = np.zeros((len(order), dims), np.int64)
    for row, i in enumerate(order):
        # groups are remainders by powers of two, so halves add up to a coarser point
        folded[row] = np.frombuffer(points[i], np.uint8).astype(np.int64).reshape(-1, dims).sum(0) if points[i] else 1 << 40
    small = folded.astype(np.uint16) if folded.max() < 65536 else folded
    return compared(ids[order], sides[order], size[order], small, percent, lambda i, j: True)


def set_links(ids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between similar sets, as far as they connect something new."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(ids[i])))
    sets = [sets[i] for i in order]
    size = np.array([len(s) for s in sets], np.int64)
    dims = int(8 * (size[-1] * (100 - percent) // percent + 4))
    points = np.zeros((len(sets), dims), np.uint32)
    for i, s in enumerate(sets):
        points[i] = np.bincount((mixed(s) % np.uint64(dims)).astype(np.int64), minlength=dims)

    def verified(i: int, j: int) -> bool:
        shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return 100 * shared >= percent * (size[i] + size[j] - shared)

    return compared(ids[order], sides[order], size, points, percent, verified)


def met_pairs(box: np.ndarray, at: np.ndarray, size: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """The least point joined with each point, by pairs that share a box and pass the bounds on size and parities.

    ``box`` rises; ``at`` is the point of an entry, ``size`` and ``bits`` (words of parities) are by point. Points of a box that is too
    full to compare here are all joined.
    """
    root = np.arange(len(size))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(pairs: np.ndarray) -> None:
        for x, y in pairs.tolist():
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        while (root != root[root]).any():
            root[:] = root[root]

    starts = np.flatnonzero(np.append(True, box[1:] != box[:-1])) if len(box) else np.empty(0, np.int64)
    count = np.diff(np.append(starts, len(box)))
    full = np.repeat(count > FULL, count)
    first = np.repeat(starts, count)
    join(np.unique(np.stack([at[first[full]], at[full]], axis=1), axis=0))
    left = np.flatnonzero(~full)
    end = np.repeat(starts + count, count)
    step = 1
    while len(left):
        left = left[left + step < end[left]]
        x, y = at[left], at[left + step]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
        small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
        near = 100 * small >= percent * large
        x, y, both = x[near], y[near], (small + large)[near]
        # similar sets share percent * both / (100 + percent) tokens at least
        most = both - 2 * -(-percent * both // (100 + percent))
        passed = []
        for part in range(0, len(x), 1 << 18):
            cut_ = slice(part, part + (1 << 18))
            passed.append(np.bitwise_count(bits[x[cut_]] ^ bits[y[cut_]]).sum(1, dtype=np.int64) <= most[cut_])
        if passed:
            ok = np.concatenate(passed)
            if ok.any():
                join(np.unique(np.stack([x[ok], y[ok]], axis=1), axis=0))
        step += 1
    return root


def box_edges(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): rows that share a box and pass its bounds, as edges to the least row that they are so joined with.

    ``rows``: (row_no, n, print, level, boxes, above, parities). A slice of rows sends, of rows with equal sets, the one with the least
    number only; so copies cost an entry per slice. Rows are not read in the order of their numbers, and the least copy of all
    is the one that stands for the others later. Boxes are dealt by class, and by hash where a class has more than a bucket holds, so that
    two rows meet in few buckets; a row's size and parities go once to each bucket that it has a box in.
    """
    bounds = class_bounds(percent)
    own = rows.where("level >= 0").groupBy("level").agg(F.sum(F.size("boxes")).alias("own"), F.sum(F.size("above")).alias("above"))
    boxes_of: dict[int, int] = {}
    for r in own.collect():
        for level, count in ((r["level"], r["own"]), (r["level"] + 1, r["above"])):
            boxes_of[level] = boxes_of.get(level, 0) + count
    buckets = {level: max(1, -(-count // BUCKET)) for level, count in boxes_of.items()}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE):
            numbers, prints = part.column(0).to_pylist(), part.column(2).to_pylist()
            least: dict[bytes, int] = {}
            for number, p in zip(numbers, prints):
                least[p] = min(number, least.get(p, number))
            part = part.filter(pa.array([least[p] == number for number, p in zip(numbers, prints)]))
            number, size, level = (np.asarray(part.column(i)) for i in (0, 1, 3))
            marks = part.column(6).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for above in (0, 1):
                lists = part.column(4 + above)
                box = np.asarray(lists.flatten()).view(np.uint64)
                row = np.repeat(np.arange(len(number)), np.diff(np.asarray(lists.offsets)))
                at = level[row] + above
                many = np.array([buckets.get(x, 1) for x in range(int(at.max(initial=0)) + 1)], np.uint64)[at]
                sub = (((box >> np.uint64(32)) * many) >> np.uint64(32)).astype(np.int64)
                order = np.lexsort((row, box, sub, at))
                box, row, at, sub = box[order], row[order], at[order], sub[order]
                cuts = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (np.diff(sub) != 0))) if len(box) else []
                for x, y in zip(cuts, [*cuts[1:], len(box)]):
                    here, index = np.unique(row[x:y], return_inverse=True)
                    wide = parity_bytes(int(at[x]), bounds)
                    bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(marks[i], np.uint8).reshape(-1, wide), axis=0) for i in here])
                    for column, value in zip(out, (int(at[x]), int(sub[x]), pack(np.diff(box[x:y], prepend=np.uint64(0))), pack(index),
                                                   number[here].tobytes(), pack(size[here]), bits.tobytes())):
                        column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), *(pa.array(c, pa.binary()) for c in out[2:])], names)

    def meet(table: pa.Table) -> pa.Table:
        columns = {name: table[name].to_pylist() for name in names[2:]}
        box = np.concatenate([np.cumsum(unpack(x), dtype=np.uint64) for x in columns.pop("boxes")])
        entries = [unpack(x).astype(np.int64) for x in columns.pop("entries")]
        number = [np.frombuffer(x, np.int64) for x in columns["rows"]]
        shift = np.cumsum([0, *map(len, number)])
        at = np.concatenate([e + s for e, s in zip(entries, shift)])
        number = np.concatenate(number)
        size = np.concatenate([unpack(x) for x in columns["sizes"]]).astype(np.int64)
        bits = np.frombuffer(b"".join(columns["parities"]), np.uint64).reshape(len(number), -1)
        by_number = np.argsort(number, kind="stable")
        place = np.empty_like(by_number)
        place[by_number] = np.arange(len(number))
        order = np.argsort(box)
        box, at = box[order], place[at][order]
        # boxes with one point go
        same = np.append(False, box[1:] == box[:-1])
        shared = same | np.append(same[1:], False)
        box, at = box[shared], at[shared]
        root = met_pairs(box, at, size[by_number], bits[by_number], percent)
        number = number[by_number]
        moved = root != np.arange(len(root))
        return pa.table({"a": number[moved], "b": number[root[moved]]})

    names = ["level", "bucket", "boxes", "entries", "rows", "sizes", "parities"]
    sent = rows.select("row_no", "n", "print", "level", "boxes", "above", "parities").where("level >= 0").mapInArrow(
        send, "level int, bucket long, boxes binary, entries binary, rows binary, sizes binary, parities binary")
    return sent.groupBy("level", "bucket").applyInArrow(meet, "a long, b long")


def _pairs(links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def family_blocks(members: DataFrame, percent: int) -> DataFrame:
    """(id, family, pair, side): the block pairs in which a member is compared. ``members``: (id, family, n).

    A family that fits into one block is one pair; a larger one is cut by size steps, of which only
    neighbours can hold similar sets, and by a hash within a step.
    """
    of_family = members.groupBy("family").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens"))
    sized = members.join(of_family, "family").withColumn(
        "large", (F.col("rows") > BLOCK_ROWS) | (F.col("tokens") > BLOCK_TOKENS))
    small = sized.where("not large").select("id", "family", F.lit("").alias("pair"), F.lit(0).alias("side"))
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    big = sized.where("large").select("id", "family", "n", step.alias("own"))
    cuts = big.groupBy("family", "own").agg(F.ceil(F.greatest(
        F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_TOKENS)).cast("int").alias("cuts"))
    offers = cuts.withColumnRenamed("cuts", "own_cuts").join(
        cuts.select("family", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)).alias("own"),
                    F.col("own").alias("other"), F.col("cuts").alias("other_cuts")), ["family", "own"])
    placed = (
        big.join(offers, ["family", "own"])
        .withColumn("mine", F.pmod(F.xxhash64("id"), F.col("own_cuts").cast("long")).cast("int"))
        .withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("other_cuts") - 1))))
    me = F.struct(F.col("own").alias("s"), F.col("mine").alias("c"))
    you = F.struct(F.col("other").alias("s"), F.col("theirs").alias("c"))
    low, high = F.least(me, you), F.greatest(me, you)
    spread = placed.select("id", "family", F.concat_ws(":", low["s"], low["c"], high["s"], high["c"]).alias("pair"),
                           (me > you).cast("int").alias("side"))
    return small.unionByName(spread)


def grouped_rows(docs: DataFrame, carried: Sequence[str], words_each: int, percent: int, key: str,
                 text: str) -> tuple[DataFrame, DataFrame]:
    """All rows (row, row_no, key, n), and (row_no, label) of those linked with another row."""
    rows = cut(index_points(docs, carried, words_each, percent, text).withColumn("row_no", F.monotonically_increasing_id()))
    rows = rows.withColumn("key", F.col("row")[key])
    full = rows.where("n > 0")
    # one print may be that of a large part of all rows: its rows are spread by salts, its first row is there once a salt
    firsts = full.groupBy("print").agg(F.min("row_no").alias("id"), F.max("row_no").alias("last")).where("id < last").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = full.select("print", "row_no", F.pmod(F.xxhash64("row_no"), F.lit(SALTS)).cast("int").alias("salt"))
    copies = cut(salted.join(firsts, ["print", "salt"]).where("row_no <> id")
                 .select(F.col("row_no").alias("a"), F.col("id").alias("b")))
    sizes = full.select(F.col("row_no").alias("id"), "n")
    edges = cut(box_edges(full, percent).distinct())
    around = edges.select(F.col("a").alias("id"), F.col("b").alias("family")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("family")).distinct()).join(
        copies, F.col("id") == copies["a"], "left_anti").join(sizes, "id")

    def pass_bound(table: pa.Table) -> pa.Table:
        return _pairs(bound_links(table["id"].to_numpy(), table["side"].to_numpy(), table["n"].to_numpy(),
                                  table["point"].to_pylist(), percent))

    points = full.select(F.col("row_no").alias("id"), "n", "point")
    close = family_blocks(cut(around), percent).hint("merge").join(points, "id").groupBy("family", "pair").applyInArrow(
        pass_bound, "a long, b long")
    members, seen = cut(
        components(cut(close)).select(F.col("node").alias("id"), F.col("label").alias("family")).join(sizes, "id"),
        rows=F.count(F.lit(1)))
    placed = family_blocks(members, percent)
    texts = rows.select(F.col("row_no").alias("id"), F.col("row")[text].cast("binary").alias("text")).join(
        small_side(members.select("id"), seen["rows"]), "id", "left_semi")

    def verify(table: pa.Table) -> pa.Table:
        hashes = WordHashes()
        sets = [shingle_set(t, words_each, hashes) for t in table["text"].to_pylist()]
        return _pairs(set_links(table["id"].to_numpy(), table["side"].to_numpy(), sets, percent))

    links = placed.hint("merge").join(texts, "id").groupBy("family", "pair").applyInArrow(verify, "a long, b long")
    return rows, components(cut(links.unionByName(copies)))


def near_groups(docs: DataFrame, words_each: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row; ``component_id`` is the smallest key reachable by links."""
    rows, labels = grouped_rows(docs, [key, text], words_each, percent, key, text)
    rows = rows.select("row_no", "key", F.col("n").alias("n_shingles"))
    labelled = labels.join(rows.select(F.col("row_no").alias("node"), "key"), "node")
    least = labelled.groupBy("label").agg(F.min("key").alias("component_id"))
    linked = labels.join(least, "label").select(F.col("node").alias("row_no"), "component_id", F.lit(True).alias("linked"))
    return rows.join(linked, "row_no", "left").select(
        F.col("key").alias(key), "n_shingles",
        F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("key")).alias("component_id"))


def one_per_group(docs: DataFrame, words_each: int = 3, percent: int = 90, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """All columns of the rows that stay: of each group the one with the smallest key, and all rows without links."""
    rows, labels = grouped_rows(docs, docs.columns, words_each, percent, key, text)
    rank = F.struct(F.col("key").isNull().alias("last"), "key", F.col("node").alias("id"))
    labelled = labels.join(rows.select(F.col("row_no").alias("node"), "key"), "node").withColumn("rank", rank)
    first = labelled.groupBy("label").agg(F.min("rank")["id"].alias("stays"))
    gone, seen = cut(labels.join(first, "label").where("node <> stays").select(F.col("node").alias("row_no")),
                     rows=F.count(F.lit(1)))
    return rows.join(small_side(gone, seen["rows"]), "row_no", "left_anti").select("row.*")
