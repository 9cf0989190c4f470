"""Mixing sources to target weights, in fixed-length blocks of words.

Method. The documents of a source, in a pseudorandom order, form one stream of words that is packed into
blocks of ``block`` words (a source's last block may be shorter). Targets say how many words of each source
the mix takes; a source gives whole passes over its blocks and part of one further pass. Every draw of a block has a
place in the mix: all draws of all sources are spread over the slots by a pseudorandom permutation and
slots are cut into shards, so that the source counts of a shard are a multinomial draw given the sources'
totals. The j-th draw of a source in its pass e takes the block that the source's own permutation for pass e maps j to.
Slots and blocks are then joined by (source, block).

The permutations are swap-or-not networks over exactly the numbers needed, worked out row by row, so
nothing is sorted or held to shuffle. Streams are laid out by sums over (source, bucket) with buckets of a
few thousand documents, so a source with a third of all rows is spread over tasks. Everything follows
from the seed and the rows, whatever the partitions: reruns agree.

Defined results: null text has size 0, is in the result and takes part in no block; a null source is a
source of its own, last in order; a null key is kept; rows equal in key and text stand next to each
other and may each be taken; with no words at all every target is 0 and no piece exists; further columns
are ignored, or carried in the struct ``row``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut
from .common import word_count

ROUNDS = 32
#: Rows of a (source, bucket) group, and draws made from one row: division of work only.
GROUP, CHUNK = 4096, 4096


def permuted(number: Column, size: Column, *tags: Column | int | str) -> Column:
    """Image of ``number`` (0 ≤ number < size) under the permutation of 0 … size-1 that the tags choose.

    Swap-or-not: each round pairs every number with (key - number) mod size and swaps the pair or not by
    one hash bit of its larger member.
    """
    labels = [t if isinstance(t, Column) else F.lit(t) for t in tags]

    def one(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*labels, r), size) - x, size)
        larger = F.greatest(x, partner)
        return F.when(F.xxhash64(*labels, r, larger).bitwiseAND(F.lit(1)) == 1, partner).otherwise(x)

    # a lambda variable is worked out once, an inlined expression at each use
    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, number.cast("long"), one)


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float, block: int) -> DataFrame:
    """One row per source: source_no, source_size, target and how its target is drawn.

    ``sizes``: (source, source_size). The level at which weight times level sums to the wanted total, with every
    source stopped at ``most`` times its size, is found from running sums in the order in which sources stop.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    stops = Window.orderBy("stop_level", "source_no")
    every = Window.partitionBy()
    before, after = stops.rowsBetween(Window.unboundedPreceding, -1), stops.rowsBetween(0, Window.unboundedFollowing)
    t = (
        sizes.withColumn("source_no", F.row_number().over(named) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                           F.col("source_no") % len(weights) + 1))
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("stop_level", F.col("cap") / F.col("weight"))
        .withColumn("wanted", share * F.sum("source_size").over(every))
        .withColumn("level", (F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                    / F.sum("weight").over(after))
        .withColumn("rank", F.row_number().over(stops))
        .withColumn("first_free", F.min(F.when(F.col("level") < F.col("stop_level"), F.col("rank"))).over(every))
        .withColumn("level", F.max(F.when(F.col("rank") == F.col("first_free"), F.col("level"))).over(every))
        .withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap")))
        .withColumn("blocks", F.ceil(F.col("source_size") / block))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
        .withColumn("rest_blocks", F.ceil(F.col("rest") / block))
        .withColumn("draws", F.col("passes") * F.col("blocks") + F.col("rest_blocks")))
    return (
        t.withColumn("first_slot", F.sum("draws").over(named) - F.col("draws"))
        .withColumn("all_draws", F.sum("draws").over(every))
        .select("source", "source_no", "source_size", "target", "blocks", "rest", "rest_blocks", "draws", "first_slot",
                "all_draws"))


@dataclass
class Mix:
    """``documents``: (row, row_no, source, source_no, size, source_size, target, start). ``sources``: from ``targets``.

    ``pieces``: (row_no, source_no, shard, place, epoch, block, from, to): words ``from`` … ``to``-1 of a document,
    in slot ``place`` of a shard. ``counts``: (shard, source_no, blocks), the drawn source counts of each shard.
    """

    documents: DataFrame
    sources: DataFrame
    pieces: DataFrame
    counts: DataFrame


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 128,
        shard: int = 1024, seed: int = 17, carried: Sequence[str] = ("doc_id",), key: str = "doc_id", text: str = "text",
        source: str = "source") -> Mix:
    spark = docs.sparkSession
    rows, seen = cut(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"),
            F.monotonically_increasing_id().alias("row_no"),
            F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("order")),
        rows=F.count(F.lit(1)))
    sources = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most, block))
    named = rows.join(
        sources.select(F.col("source").alias("its_source"), "source_no", "source_size", "target"),
        F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    buckets = max(1, seen["rows"] // GROUP)
    named = named.withColumn("bucket", F.pmod("order", F.lit(buckets)))
    narrow = named.select("row_no", "source_no", "bucket", "order", "size")
    firsts = narrow.groupBy("source_no", "bucket").agg(F.sum("size").alias("words")).select(
        "source_no", "bucket",
        (F.sum("words").over(Window.partitionBy("source_no").orderBy("bucket")) - F.col("words")).alias("first"))
    running = F.sum("size").over(Window.partitionBy("source_no", "bucket").orderBy("order", "size", "row_no"))
    starts = (
        narrow.withColumn("own", running - F.col("size")).join(firsts, ["source_no", "bucket"])
        .select("row_no", "source_no", "size", (F.col("first") + F.col("own")).alias("start")))
    starts = cut(starts)

    slots = (
        sources.where("draws > 0")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(draws - 1) div {CHUNK}"))))
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source_no", "chunk")
        .withColumn("draw", F.explode(F.sequence(
            F.col("chunk") * CHUNK, F.least(F.col("draws"), (F.col("chunk") + 1) * CHUNK) - 1)))
        .withColumn("epoch", F.expr("draw div blocks"))
        .withColumn("slot", permuted(F.col("first_slot") + F.col("draw"), F.col("all_draws"), seed, "slots"))
        .select(
            "source_no", "epoch",
            permuted(F.expr("draw % blocks"), F.col("blocks"), seed, F.col("source_no"), F.col("epoch")).alias("block"),
            F.expr(f"slot div {shard}").alias("shard"), F.expr(f"slot % {shard}").alias("place"),
            F.when((F.col("draw") == F.col("draws") - 1) & (F.col("rest_blocks") > 0),
                   F.col("rest") - (F.col("rest_blocks") - 1) * block).otherwise(block).alias("words")))
    parts = (
        starts.where("size > 0")
        .withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
        .withColumn("block_start", F.col("block") * block))
    # both sides are made from few rows but hold one per block, so neither is one to broadcast
    pieces = (
        parts.hint("merge").join(slots, ["source_no", "block"])
        .select(
            "row_no", "source_no", "shard", "place", "epoch", "block",
            (F.greatest("start", "block_start") - F.col("start")).alias("from"),
            (F.least(F.col("start") + F.col("size"), F.col("block_start") + F.col("words")) - F.col("start")).alias("to"))
        .where(F.col("from") < F.col("to")))
    documents = named.drop("bucket", "order")
    return Mix(documents, sources, pieces, slots.groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("blocks")))


def taken_words(mixed: Mix) -> DataFrame:
    """Per document: the carried columns, size, source_size, target and taken (words of it in the mix)."""
    taken = mixed.pieces.groupBy("row_no").agg(F.sum(F.col("to") - F.col("from")).alias("taken"))
    return mixed.documents.join(taken, "row_no", "left").select(
        "row.*", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_texts(mixed: Mix, text: str = "text") -> DataFrame:
    """One row per piece, with the carried columns, where ``text`` is the piece's words and the blanks between them.

    A document's places are few (twice its own blocks at most), so they are gathered per document and its
    text is read and split once.
    """
    places = mixed.pieces.groupBy("row_no").agg(
        F.sort_array(F.collect_list(F.struct("shard", "place", "from", "to"))).alias("places"))
    words = F.regexp_extract_all(F.col(f"row.{text}"), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    cut_out = F.transform(F.array(words), lambda w: F.transform(F.col("places"), lambda p: F.struct(
        p["shard"].alias("shard"), p["place"].alias("place"),
        F.array_join(F.slice(w, p["from"].cast("int") + 1, (p["to"] - p["from"]).cast("int")), "").alias("text"))))[0]
    return (
        mixed.documents.join(places, "row_no")
        .select("row", F.explode(cut_out).alias("piece"))
        .select(F.col("row").withField(text, F.col("piece.text")).alias("row"))
        .select("row.*"))
