"""Trie of conversation prefixes, with count-min screening of prefix digests.

Every prefix of every conversation gets a 128-bit digest: the XOR of a hash of (depth, turn) over its
turns, so the parent's digest is one XOR away. A count-min sketch of all digests is built from sorted
cell lists, a few bytes a prefix. An estimate of one proves that a single conversation starts so. What
follows such a prefix is a tail: its nodes are complete as they stand and leave without a shuffle. Only
the prefixes that may be shared, and the first lone prefix of each conversation, are shuffled and
grouped exactly, so a collision in the sketch costs time and never a result.

Sums over subtrees need no loop over depths. A node is represented by its smallest member, and every
node above it is a prefix of that member. So what a conversation's own nodes add is summed from its end
backwards, and each of its prefixes gets the sum from there on; adding these up by digest gives the
subtree.

Hot rows: a long conversation is numbered in range parts and scanned in blocks of BLOCK turns, with what
lies before or after a block carried over; a digest that many conversations share (a system prompt, the
root) is pre-aggregated, and its rows meet their node by a broadcast of the few hottest nodes. The sketch goes through the driver: at most three times ``sketch_cells`` bits.

Rows without conv_id belong to no conversation. Null roles and texts count as empty, null turns come
first, ties are ordered by the SHA-256 of role and text; repeated rows are turns of their own. Other
columns may have any names. No conversations, no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaudit.functions.joins import meet
from metaudit.llm.shared import saved
from metaudit.llm.words import mix

SKETCH_ROWS = 3
CELLS_A_PREFIX = 4
BLOCK_BITS = 16  # cells of a sketch block
FLUSH = 1 << 20  # prefixes of a task whose cells are sorted at once
BLOCK = 1024


def digested(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """The turns without their texts: conv, turn, key (SHA-256 of role and text) and words."""
    role, text = (F.coalesce(conversations[c], F.lit("")) for c in (role_col, text_col))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.select(
        conversations[conv_col].alias("conv"), conversations[turn_col].alias("turn"),
        F.unhex(F.sha2(content, 256)).alias("key"),
        F.size(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))).cast("long").alias("words"),
    ).where("conv IS NOT NULL")


def numbered(turns: DataFrame) -> DataFrame:
    """The turns with their position (from 0) in their conversation, by turn and key.

    Parts are ranges of the order, so a long conversation lies in several; at most one conversation
    goes on into each part, which bounds the table of offsets. The turns are written first, as
    cutting ranges reads them twice.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("key")]
    parts = saved(saved(turns).repartitionByRange(F.col("conv"), *order).withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (parts.groupBy("conv", "part").count().withColumn("before", F.sum("count").over(earlier))
               .where("before > 0").select("conv", "part", "before"))
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)) - 1
    return (parts.withColumn("place", place).join(F.broadcast(offsets), ["conv", "part"], "left")
            .select("conv", (F.col("place") + F.coalesce("before", F.lit(0))).cast("long").alias("position"), "key", "words"))


def prefix_digests(turns: DataFrame) -> DataFrame:
    """Every prefix from one turn on: conv, depth, block, digest (a, b), parent (pa, pb), last turn's words, last."""
    rows = numbered(turns).select("conv", (F.col("position") + 1).alias("depth"), "key", "words")
    rows = rows.select("conv", "depth", F.floor(F.col("depth") / BLOCK).alias("block"), "words",
                       F.xxhash64("depth", "key").alias("ta"), F.xxhash64(F.lit(7), "key", "depth").alias("tb"))
    ordered = Window.partitionBy("conv").orderBy("block")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "block").agg(F.bit_xor("ta").alias("ta"), F.bit_xor("tb").alias("tb")).select(
        "conv", "block", F.bit_xor("ta").over(before).alias("ca"), F.bit_xor("tb").over(before).alias("cb"),
        F.lead("block").over(ordered).isNull().alias("final"))
    inside = Window.partitionBy("conv", "block").orderBy("depth")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", F.bit_xor("ta").over(running).alias("la"), F.bit_xor("tb").over(running).alias("lb"),
                       F.lead("depth").over(inside).isNull().alias("closes"))
    rows = rows.join(blocks, ["conv", "block"])
    a, b = (F.col(f"l{x}").bitwiseXOR(F.coalesce(f"c{x}", F.lit(0))) for x in "ab")
    return rows.select("conv", "depth", "block", "words", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("ta")).alias("pa"),
                       b.bitwiseXOR(F.col("tb")).alias("pb"), (F.col("final") & F.col("closes")).alias("last"))


def cells(a: np.ndarray, b: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each digest in every row of the sketch."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    return [(mix(a + np.uint64(2 * row + 1) * b) >> np.uint64(64 - bits)) + np.uint64(row << bits) for row in range(SKETCH_ROWS)]


def sketch(prefixes: DataFrame, bits: int) -> np.ndarray:
    """One bit a cell: whether the cell counts two prefixes or more (packed, all rows in line)."""

    def lists(batches):
        held = []

        def flush():
            all_cells = np.sort(np.concatenate(held))
            keep = np.ones(len(all_cells), bool)
            keep[2:] = all_cells[2:] != all_cells[:-2]  # two of a kind say enough
            all_cells = all_cells[keep]
            block, first = np.unique(all_cells >> np.uint64(BLOCK_BITS), return_index=True)
            low = (all_cells & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint16)
            parts = [x.tobytes() for x in np.split(low, first[1:])]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64)), pa.array(parts, pa.binary())], ["block", "low"])

        for batch in batches:
            held += cells(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits)
            if sum(map(len, held)) >= SKETCH_ROWS * FLUSH:
                yield flush()
        if held and sum(map(len, held)):
            yield flush()

    def merged(table: pa.Table) -> pa.Table:
        counts = np.zeros(1 << BLOCK_BITS, np.uint8)
        for part in table.column("low"):
            low, times = np.unique(np.frombuffer(part.as_buffer(), np.uint16), return_counts=True)
            counts[low] = np.minimum(counts[low] + times, 2)
        return pa.table({"block": table.column("block")[:1], "bits": [np.packbits(counts == 2, bitorder="little").tobytes()]})

    found = (prefixes.select("a", "b").mapInArrow(lists, "block long, low binary")
             .groupBy("block").applyInArrow(merged, "block long, bits binary"))
    size = 1 << (BLOCK_BITS - 3)
    twice = np.zeros(max(SKETCH_ROWS << bits >> 3, size), np.uint8)
    for block, packed in found.collect():  # at most SKETCH_ROWS * 2**bits bits in all
        twice[block * size:(block + 1) * size] = np.frombuffer(packed, np.uint8)
    return twice


def screened(prefixes: DataFrame, bits: int) -> DataFrame:
    """The prefixes with ``alone`` and ``tail``: the estimate of the prefix, and of its parent, is one."""
    twice = prefixes.sparkSession.sparkContext.broadcast(sketch(prefixes, bits))
    schema = f"{prefixes._jdf.schema().toDDL()}, alone boolean, tail boolean"
    names = [*prefixes.columns, "alone", "tail"]

    def lone(a, b):
        flags = [twice.value[c >> np.uint64(3)] >> (c & np.uint64(7)).astype(np.uint8) & 1 for c in cells(a, b, bits)]
        return np.minimum.reduce(flags) == 0

    def run(batches):
        for batch in batches:
            column = {n: batch.column(n).to_numpy() for n in ("depth", "a", "b", "pa", "pb")}
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lone(column["a"], column["b"])),
                 pa.array(lone(column["pa"], column["pb"]) & (column["depth"] > 1))], names)

    return prefixes.mapInArrow(run, schema)


def prefix_trie(turns: DataFrame, members: DataFrame, *, sketch_cells: int = 1 << 27) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie, and which conversations end at the shared ones.

    ``turns`` is a table as ``digested`` gives it; ``members`` (conv) lists all conversations, also
    those without turns. Nodes: conv_id (smallest member) and depth, which together name a node,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and n_ends. Ends: conv_id, depth and
    member, for the nodes of two members or more; at a node of one member only that one can end.
    """
    prefixes = saved(prefix_digests(turns))
    wanted = max(CELLS_A_PREFIX * prefixes.count(), 1 << BLOCK_BITS)
    bits = min((wanted - 1).bit_length(), sketch_cells.bit_length() - 1)
    judged = saved(screened(prefixes, bits))

    roots = members.select("conv").distinct().join(prefixes.where("depth = 1").select("conv", F.lit(True).alias("some")), "conv", "left")
    roots = roots.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("block"),
                         F.lit(0).cast("long").alias("words"), *[F.lit(0).cast("long").alias(x) for x in "ab"],
                         *[F.lit(None).cast("long").alias(x) for x in ("pa", "pb")], F.isnull("some").alias("last"))
    open_rows = judged.where("NOT tail AND NOT alone").select(*roots.columns)
    shared = roots.unionByName(open_rows)
    first_lone = judged.where("NOT tail AND alone")

    nodes = shared.groupBy("a", "b").agg(
        F.count("*").alias("n"), F.min("conv").alias("rep"), F.min("depth").alias("depth"), F.min("words").alias("words"),
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.count_if("last").alias("n_ends"))
    below = nodes.select("pa", "pb").where("pa IS NOT NULL").unionAll(first_lone.select("pa", "pb"))
    below = below.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("kids"))
    nodes = saved(nodes.drop("pa", "pb").join(below, ["a", "b"], "left").withColumn("kids", F.coalesce("kids", F.lit(0))))

    flow = saved(own_and_above(shared, first_lone, nodes))
    sums = from_the_end(flow)
    grouped = (sums.where("n_rows > 1 AND (mine OR worth > 0 OR leaf)").groupBy("a", "b")
               .agg(F.max(F.when(F.col("mine"), F.col("above"))).alias("parent_conv_id"),
                    F.count_if("leaf").alias("n_leaves"), F.sum("worth").alias("saved_tokens")))
    many = nodes.where("n > 1").join(grouped, ["a", "b"]).select(
        F.col("rep").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"), "n_leaves", "saved_tokens", "n_ends")
    ends = flow.where("n_rows > 1 AND last").select(F.col("rep").alias("conv_id"), "depth", F.col("conv").alias("member"))
    single = lone_nodes(sums.where("n_rows = 1"), F.col("above"))
    tails = lone_nodes(judged.where("tail"), F.col("conv"))
    return many.unionByName(single).unionByName(tails), ends


def lone_nodes(rows: DataFrame, parent: Column) -> DataFrame:
    """Nodes with one member: one leaf below, nothing saved; children and ends follow from ``last``."""
    at_end = F.col("last").cast("long")
    one = F.lit(1).cast("long")
    return rows.select(F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), one.alias("n_convs"),
                       (one - at_end).alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
                       at_end.alias("n_ends"))


def own_and_above(shared: DataFrame, first_lone: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of possibly shared prefixes with the members, representative and children of their nodes."""
    met = meet(shared, nodes.select("a", "b", F.col("n").alias("n_rows"), "rep", "kids"), ["a", "b"], "n_rows")
    mine = F.col("conv") == F.col("rep")
    found = met.select("conv", "depth", "block", "a", "b", "last", "n_rows", "rep", mine.alias("mine"),
                       F.when(mine, (F.col("n_rows") - 1) * F.col("words")).otherwise(0).alias("worth"),
                       ((F.col("n_rows") == 1) | (mine & F.col("last") & (F.col("kids") == 0))).alias("leaf"))
    return found.unionByName(first_lone.select(
        "conv", "depth", "block", "a", "b", "last", F.lit(1).cast("long").alias("n_rows"), F.col("conv").alias("rep"),
        F.lit(True).alias("mine"), F.lit(0).cast("long").alias("worth"), F.lit(True).alias("leaf")))


def from_the_end(flow: DataFrame) -> DataFrame:
    """Per row: worth and leaf of its conversation from here to the end, and the parent's representative."""
    ordered = Window.partitionBy("conv").orderBy("block")
    after = Window.partitionBy("conv").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = flow.groupBy("conv", "block").agg(F.sum("worth").alias("worth"), F.max("leaf").alias("leaf"),
                                               F.max_by("rep", "depth").alias("rep"))
    blocks = blocks.select("conv", "block", F.sum("worth").over(after).alias("worth_after"),
                           F.max("leaf").over(after).alias("leaf_after"), F.lag("rep").over(ordered).alias("rep_before"),
                           F.count("*").over(Window.partitionBy("conv")).alias("n_blocks"))
    inside = Window.partitionBy("conv", "block").orderBy("depth")
    rest = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = flow.select("conv", "depth", "block", "a", "b", "last", "n_rows", "mine", F.sum("worth").over(rest).alias("worth"),
                       F.max("leaf").over(rest).alias("leaf"), F.lag("rep").over(inside).alias("above"))
    rows = rows.join(blocks.where("n_blocks > 1").drop("n_blocks"), ["conv", "block"], "left")
    return rows.select("conv", "depth", "a", "b", "last", "n_rows", "mine",
                       (F.col("worth") + F.coalesce("worth_after", F.lit(0))).alias("worth"),
                       (F.col("leaf") | F.coalesce("leaf_after", F.lit(False))).alias("leaf"),
                       F.coalesce("above", "rep_before").alias("above"))


def joined_ends(ends: DataFrame, width: int = 4096) -> DataFrame:
    """Per shared node the decimal ids of the conversations that end there, ascending, joined by commas.

    Ids are first joined in ranges of ``width``; the last step reads one string a range.
    """
    ranges = ends.groupBy("conv_id", "depth", F.floor(F.col("member") / width).alias("range")).agg(
        F.array_join(F.array_sort(F.collect_list("member")).cast("array<string>"), ",").alias("ids"))
    return ranges.groupBy("conv_id", "depth").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("range", "ids"))), lambda r: r["ids"]), ",").alias("ids"))
