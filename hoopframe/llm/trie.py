"""Prefix trie of conversations with subtree totals, rolled up in bands of depth.

A node is a distinct sequence of first turns, identified by its depth and 128 bits: the exclusive
or of a hash of (place, role, text digest) over its turns, so a prefix is a running value and the
parent's identity is the node's own without its last turn.

Subtree totals go through bands of ``BAND`` depths. A node explodes only to its ancestors within
its band, at most ``BAND`` rows. The tops of bands form a tree again, ``BAND`` times lower, whose
nodes hold their band's totals; it is banded in the same way until one band is left. Then the
completed totals of band tops go back down to the ancestors in the band above theirs. A
conversation of n turns takes about 2 * log(n) / log(BAND) rounds.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hoopframe.operators.ordering import number_rows
from hoopframe.sources.staging import stage

from .common import small_batches

#: Depths in a band; a node explodes to at most as many rows.
BAND = 8
#: Ids joined to one piece before a node's pieces meet.
PIECE = 1000
NODE = ["depth", "a", "b"]


def unsigned_crc(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary"))


def turns(talks: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, role, digest of the text and its UTF-8 bytes; rows without a conversation go."""
    text = F.coalesce(talks[text_col].cast("string"), F.lit(""))
    rows = talks.select(talks[conv_col].cast("long").alias("conv_id"), talks[turn_col].cast("long").alias("turn"),
                        F.coalesce(talks[role_col].cast("string"), F.lit("")).alias("role"),
                        F.md5(text).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return rows.where("conv_id IS NOT NULL")


def in_order(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``pos`` (from 1) within their conversation, and conv_id with its number of turns.

    Places come from a total order over all rows, so a conversation of any length is spread.
    """
    placed = stage(number_rows(rows, ["conv_id", F.asc_nulls_first("turn"), "role", "digest"], "place"), "turns")
    convs = stage(placed.groupBy("conv_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")), "conversations")
    return placed.join(convs.select("conv_id", "first"), "conv_id").withColumn("pos", F.col("place") - F.col("first") + 1).drop("first", "place"), convs


def rebuilt(rows: DataFrame, convs: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations with their depth, and conv_id with its number of turns.

    Conversation c takes the first crc32(c) % ``most`` turns of c - c % ``group`` and its own turns
    after as many.
    """
    heads = convs.select("conv_id", "n", (unsigned_crc(F.col("conv_id")) % most).alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = stage(heads.join(bases, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("lent"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("own")), "plan")
    kept = ["role", "digest", "bytes"]
    # at most `most` - 1 turns of a base, each for at most 2 * group - 1 conversations
    early = rows.where((F.col("pos") < most) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), "pos", *kept)
    lent = early.join(plan.where("lent > 0").select("conv_id", "base", "lent"), "base").where("pos <= lent").select(
        "conv_id", F.col("pos").alias("depth"), *kept)
    own = rows.join(plan.where("own > 0").select("conv_id", "h", "lent"), "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("depth"), *kept)
    return lent.unionByName(own), plan.select("conv_id", (F.col("lent") + F.col("own")).alias("n"))


def prefixes(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """conv_id, depth, (a, b) of the prefix, (pa, pb) of its parent, bytes of the last turn, last (no turn follows).

    The running value of a conversation is built in ranges of rows: within a range by a window, over
    ranges from the values of the conversation's earlier ranges, of which each range has one at most.
    """
    mark = [F.xxhash64(F.lit(seed), "depth", "role", "digest").alias(x) for seed, x in ((1, "ha"), (2, "hb"))]
    marked = rows.select("conv_id", "depth", "bytes", *mark)
    held = stage(marked.repartitionByRange("conv_id", "depth").withColumn("part", F.spark_partition_id()), "marks")
    sums = held.groupBy("conv_id", "part").agg(F.bit_xor("ha").alias("sa"), F.bit_xor("hb").alias("sb"))
    wide = held.groupBy("conv_id").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("conv_id")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (sums.join(F.broadcast(wide), "conv_id")  # at most one conversation crosses an edge between ranges
               .select("conv_id", "part", F.bit_xor("sa").over(before).alias("ca"), F.bit_xor("sb").over(before).alias("cb"))
               .where("ca IS NOT NULL"))
    here = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = held.select("*", F.bit_xor("ha").over(here).alias("la"), F.bit_xor("hb").over(here).alias("lb"))
    zero = F.lit(0).cast("long")
    whole = local.join(F.broadcast(carried), ["conv_id", "part"], "left").select(
        "conv_id", "depth", "bytes", "ha", "hb", F.col("la").bitwiseXOR(F.coalesce("ca", zero)).alias("a"),
        F.col("lb").bitwiseXOR(F.coalesce("cb", zero)).alias("b"))
    return whole.join(lengths, "conv_id").select(
        "conv_id", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("ha")).alias("pa"), F.col("b").bitwiseXOR(F.col("hb")).alias("pb"),
        "bytes", (F.col("depth") == F.col("n")).alias("last"))


def nodes_of(rows: DataFrame) -> DataFrame:
    """One row a node: depth, a, b, pa, pb, conv_id (smallest member), n_convs, leaf, saved (the node's own)."""
    each = rows.groupBy(*NODE).agg(F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.min("conv_id").alias("conv_id"),
                                   F.count(F.lit(1)).alias("n_convs"), F.min("last").alias("leaf"), F.max("bytes").alias("bytes"))
    return each.select(*NODE, "pa", "pb", "conv_id", "n_convs", F.col("leaf").cast("long").alias("leaves"),
                       ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))


def band_paths(rows: DataFrame, step: int) -> DataFrame:
    """conv_id, band and the conversation's nodes at depths divisible by ``step`` in that band, by depth."""
    per = step * BAND
    return (rows.where(F.col("depth") % step == 0)
            .groupBy("conv_id", F.floor(F.col("depth") / per).alias("band"))
            .agg(F.array_sort(F.collect_list(F.struct(*NODE))).alias("path")))  # at most BAND entries


def lifted(nodes: DataFrame, paths: DataFrame, per: int, up: int) -> DataFrame:
    """Sums of ``leaves`` and ``saved`` over the ancestors of each node in its band (``up`` 0), itself included, or in the band above (1)."""
    mine = nodes.select("conv_id", F.col("depth").alias("d"), (F.floor(F.col("depth") / per) - up).alias("band"), "leaves", "saved")
    each = mine.join(paths, ["conv_id", "band"]).select("d", "leaves", "saved", F.explode("path").alias("node")).where("node.depth <= d")
    return each.select("node.*", "leaves", "saved").groupBy(*NODE).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def subtree_totals(nodes: DataFrame, rows: DataFrame, deepest: int) -> DataFrame:
    """depth, a, b, leaves and saved, each summed over the node's subtree.

    ``rows`` are the (conv_id, depth, a, b) of all conversations, the root included.
    """
    levels, step, now = [], 1, nodes.select("conv_id", *NODE, "leaves", "saved")
    while True:
        paths = stage(band_paths(rows, step), "paths")
        sums = lifted(now, paths, step * BAND, 0)
        held = stage(sums.join(nodes.select(*NODE, "conv_id"), NODE), "bands")
        levels.append((step, paths, held))
        step *= BAND
        if deepest < step:
            break
        now = held.where(F.col("depth") % step == 0)
    total = levels[-1][2]
    for step, paths, held in reversed(levels[:-1]):
        per = step * BAND
        # ``total`` is complete for depths divisible by ``per``; each goes to its ancestors in the band above
        down = lifted(total.where("depth > 0"), paths, per, 1)
        both = held.select("conv_id", *NODE, "leaves", "saved").unionByName(down.withColumn("conv_id", F.lit(None).cast("long")))
        # what came down completes a band's sums, for its top too
        total = stage(both.groupBy(*NODE).agg(F.max("conv_id").alias("conv_id"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")),
                      "totals")
    return total.select(*NODE, "leaves", "saved")


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, a, b and the SHA-256 of the node's conv_ids, ascending, comma-joined.

    Ids are sorted over ranges and joined to pieces of ``PIECE`` there; then a node's pieces pass
    one digest in order. Neither step holds a node's ids at once.
    """
    def pieces(batches):
        key, ids = None, []

        def row(key, ids):
            return (*key, ids[0], ",".join(map(str, ids)))

        for batch in batches:
            out = []
            for depth, a, b, conv in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id"))):
                if ids and (key != (depth, a, b) or len(ids) == PIECE):
                    out.append(row(key, ids))
                    ids = []
                key = (depth, a, b)
                ids.append(conv)
            yield from table(out, "piece", pa.string())
        if ids:
            yield from table([row(key, ids)], "piece", pa.string())

    def digest(batches):
        key, held = None, None
        for batch in batches:
            out = []
            for depth, a, b, first, piece in zip(*(batch.column(c).to_pylist() for c in (*NODE, "first", "piece"))):
                if key == (depth, a, b):
                    held.update(b"," + piece.encode())
                    continue
                if key is not None:
                    out.append((*key, 0, held.hexdigest()))
                key, held = (depth, a, b), hashlib.sha256(piece.encode())
            yield from table(out, "ends", pa.string())
        if key is not None:
            yield from table([(*key, 0, held.hexdigest())], "ends", pa.string())

    def table(rows, name, kind):
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], kind)],
                                             names=[*NODE, "first", name])

    order = [*NODE, "conv_id"]
    cut = (ends.select(*[F.col(c).cast("long") for c in order]).repartitionByRange(*order).sortWithinPartitions(*order)
           .mapInArrow(pieces, "depth long, a long, b long, first long, piece string"))
    return (cut.repartition(*NODE).sortWithinPartitions(*NODE, "first")
            .mapInArrow(digest, "depth long, a long, b long, first long, ends string").drop("first"))


def conversation_trie(talks: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text", rebuild: bool = True) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are read in the order of turn, null first; equal turns follow by role, then by
    the text's MD5, and a repeated row is a turn of its own. A null role or text counts as empty.
    Rows without a conversation id belong to none and are left out. With ``rebuild`` off the
    conversations stay as they are. An empty table has no node, not even a root; a conversation
    whose rebuilt form has no turn ends at the root. Texts of any length enter as digests, two
    prefixes that differ are told apart by 128 bits. Of other columns none is read.
    """
    small_batches(talks.sparkSession)
    rows, convs = in_order(turns(talks, conv_col, turn_col, role_col, text_col))
    if rebuild:
        rows, lengths = rebuilt(rows, convs)
    else:
        rows, lengths = rows.withColumnRenamed("pos", "depth"), convs.select("conv_id", "n")
    below = stage(prefixes(rows, lengths), "prefixes")
    zero = F.lit(0).cast("long")
    roots = lengths.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), F.lit(None).cast("long").alias("pa"),
                           F.lit(None).cast("long").alias("pb"), zero.alias("bytes"), (F.col("n") == 0).alias("last"))
    every = roots.unionByName(below)
    nodes = stage(nodes_of(every), "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = subtree_totals(nodes, every.select("conv_id", *NODE), deepest)
    ends = end_digests(every.where("last").select(*NODE, "conv_id"))
    inner = nodes.where("depth > 0")
    children = inner.groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    # the parent's smallest member: the root's is one number, other parents are met by their key
    root = nodes.where("depth = 0").select("conv_id").first()
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    deep = inner.where("depth > 1").join(parents.where("depth > 1"), ["depth", "pa", "pb"])
    high = nodes.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root.conv_id if root else None).cast("long")))
    found = (high.unionByName(deep).join(sums.withColumnRenamed("leaves", "n_leaves").withColumnRenamed("saved", "saved_tokens"), NODE)
             .join(children, NODE, "left").join(ends, NODE, "left"))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves",
                        "saved_tokens", F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
