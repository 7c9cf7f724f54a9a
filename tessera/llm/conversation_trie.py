"""Prefix trie of conversations by whole-sequence collapse.

Identical conversations become one weighted sequence with the list of those that
end there; the sequences that are a proper prefix of another are found by an
anti-join, the others are the trie's leaves; then only one conversation per
sequence is expanded into its prefixes, and these are aggregated by weight.

A prefix is named by its depth and the exclusive or of its turns' 64-bit hashes,
two of them with different seeds, each turn's hashed with its place. Such names
come from partial aggregates and running values, so no conversation is gathered
into a task.

Sums over subtrees need no walk. With n(y) members, b(y) bytes of node y's own
turn and B its running bytes, the sum of n*b below x is, over the sequences s
through x, weight(s) * (bytes of s from x on); and the sum of b counts each node
once, with the sequence that owns it, the one with the smallest id. What a sequence
owns is the end of its path from one depth on, so that sum, too, is one number per
(sequence, prefix).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import in_range_order, nth_within
from .common import id_crc, written

BLOCK = 4096      # ids that are joined to one text before they move to the task of their list
FAMILY, HEADS = 5, 9
KEY = ["depth", "k1", "k2"]


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``pos`` (from 1, by turn, null first, then role and content), ``content`` (a SHA-256 of role and
    text) and ``bytes`` of the text. Turns without conv_id belong to no conversation and are left out."""
    role, text = _text("role"), _text("text")
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("content"),
        F.octet_length(text).cast("long").alias("bytes"))
    return nth_within(turns, ["conv_id"], "turn", ["role", "content"], "pos").select(
        "conv_id", F.col("pos").cast("long").alias("pos"), "content", "bytes")


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with the first h turns of conversation c - c % family in place of its own first h.

    h is crc32(decimal c) % heads. Returns the ids and the turns (as :func:`ordered_turns` has them).
    """
    counts = written(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "trie-ids")
    ids = counts.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"),
                        (id_crc(F.col("conv_id")) % heads).alias("h"))
    bases = counts.select(F.col("conv_id").alias("base"), "n")
    ids = written(ids.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("n", F.lit(0)))).drop("n"),
                  "trie-heads")
    own = (turns.join(ids, "conv_id").where(F.col("pos") > F.col("h"))
           .select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "content", "bytes"))
    first = turns.where(F.col("pos") < heads).select(F.col("conv_id").alias("base"), "pos", "content", "bytes")
    head = ids.join(first, "base").where(F.col("pos") <= F.col("head")).select("conv_id", "pos", "content", "bytes")
    return ids.select("conv_id"), own.unionByName(head)


def _hashed(turns: DataFrame) -> DataFrame:
    g = [F.xxhash64(F.lit(seed), "pos", "content").alias(f"g{seed}") for seed in (1, 2)]
    return turns.select("conv_id", "pos", *g, "bytes")


def _sequences(ids: DataFrame, hashed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation's whole name, and one row per distinct sequence: rep (its smallest id), weight and bytes."""
    zero = F.lit(0).cast("long")
    whole = hashed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"), F.bit_xor("g1").alias("k1"),
                                          F.bit_xor("g2").alias("k2"), F.sum("bytes").alias("total"))
    whole = written(ids.join(whole, "conv_id", "left").select(
        "conv_id", *(F.coalesce(c, zero).alias(c) for c in ("depth", "k1", "k2", "total"))), "trie-names")
    alike = whole.groupBy(*KEY).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("weight"),
                                    F.max("total").alias("total"))
    return whole, written(alike, "trie-sequences")


def _list_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per rep over its blocks, which come in order; holds one batch of blocks."""
    rep, digest = None, None
    for batch in batches:
        out: list[tuple[int, str]] = []
        for one, text in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist()):
            if digest is not None and one == rep:
                digest.update(b",")
            else:
                if digest is not None:
                    out.append((rep, digest.hexdigest()))
                rep, digest = one, hashlib.sha256()
            digest.update(text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([d for _, d in out])],
                                             names=["rep", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([digest.hexdigest()])],
                                         names=["rep", "ends_sha256"])


def _ends(whole: DataFrame, sequences: DataFrame) -> DataFrame:
    """Per sequence the SHA-256 of its conversations' ids, ascending and joined by commas.

    A list that is hashed as one text has to pass one task in order; it gets there
    as texts of 4,096 ids, made where the range partitions have sorted them.
    """
    members = whole.join(sequences.select(*KEY, "rep"), KEY).select("rep", "conv_id")
    placed, part, place = in_range_order(members, [F.col("rep"), F.col("conv_id")], "trie-members")
    block = F.floor(F.col(place) / BLOCK)
    blocks = placed.groupBy("rep", part, block.alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    joined = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return (blocks.select("rep", part, "block", joined.alias("ids")).repartition("rep")
            .sortWithinPartitions("rep", part, "block").select("rep", "ids")
            .mapInArrow(_list_hashes, "rep long, ends_sha256 string"))


def _prefixes(sequences: DataFrame, hashed: DataFrame) -> DataFrame:
    """All prefixes of one conversation per sequence: rep, their name, their parent's, own bytes and bytes so far.

    Running values inside (conversation, range partition), and for a conversation
    that spans several partitions what the earlier ones hold, a row for each.
    """
    reps = sequences.select(F.col("rep").alias("conv_id"))
    placed, part, place = in_range_order(hashed.join(reps, "conv_id", "left_semi"), [F.col("conv_id"), F.col("pos")],
                                         "trie-turns")
    inner = Window.partitionBy(part, "conv_id").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("conv_id", part).agg(F.bit_xor("g1").alias("s1"), F.bit_xor("g2").alias("s2"),
                                               F.sum("bytes").alias("sb"))
    zero = F.lit(0).cast("long")
    before = sums.select("conv_id", part, F.coalesce(F.bit_xor("s1").over(earlier), zero).alias("s1"),
                         F.coalesce(F.bit_xor("s2").over(earlier), zero).alias("s2"),
                         F.coalesce(F.sum("sb").over(earlier), zero).alias("sb"))
    run = placed.select("conv_id", part, F.col("pos").alias("depth"), "g1", "g2", "bytes",
                        F.bit_xor("g1").over(inner).alias("r1"), F.bit_xor("g2").over(inner).alias("r2"),
                        F.sum("bytes").over(inner).alias("rb")).join(before, ["conv_id", part])
    k1, k2 = F.col("r1").bitwiseXOR(F.col("s1")), F.col("r2").bitwiseXOR(F.col("s2"))
    below = run.select(F.col("conv_id").alias("rep"), "depth", k1.alias("k1"), k2.alias("k2"),
                       k1.bitwiseXOR(F.col("g1")).alias("q1"), k2.bitwiseXOR(F.col("g2")).alias("q2"), "bytes",
                       (F.col("rb") + F.col("sb")).alias("upto"))
    none = F.lit(None).cast("long")
    roots = sequences.select("rep", *(zero.alias(c) for c in KEY), none.alias("q1"), none.alias("q2"),
                             zero.alias("bytes"), zero.alias("upto"))
    return written(below.unionByName(roots), "trie-prefixes")


def prefix_trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie of ``turns`` (conv_id, pos gapless from 1, content, bytes), one row per node.

    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at
    the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and
    ``ends_sha256``. A node's last turn is turn ``depth`` of conversation
    ``conv_id``. Conversations of ``ids`` without turns are members of the root
    alone. Without conversations there is no node.
    """
    hashed = written(_hashed(turns), "trie-hashed")
    whole, sequences = _sequences(ids, hashed)
    prefixes = _prefixes(sequences, hashed)
    weights = sequences.select("rep", "weight", "total", F.col("depth").alias("length"))
    weighted = prefixes.join(weights, "rep")
    inside = weighted.where(F.col("depth") < F.col("length")).select(*KEY).distinct()
    leaves = sequences.join(inside, KEY, "left_anti").select("rep", F.lit(1).alias("leaf"))
    nodes = written(weighted.groupBy(*KEY).agg(
        F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("bytes").alias("bytes"),
        F.max("upto").alias("upto"), F.max("q1").alias("q1"), F.max("q2").alias("q2")), "trie-nodes")
    # a sequence owns the nodes whose smallest member it is: its path's end, from one depth on
    owned = nodes.groupBy(F.col("conv_id").alias("rep")).agg(F.min(F.col("upto") - F.col("bytes")).alias("from"))
    parts = written(weights.join(leaves, "rep", "left").join(owned, "rep", "left"), "trie-parts")
    start = F.col("upto") - F.col("bytes")
    sums = prefixes.join(parts, "rep").groupBy(*KEY).agg(
        F.sum(F.col("weight") * (F.col("total") - start)).alias("spent"),
        F.sum(F.when(F.col("from").isNotNull(), F.col("total") - F.greatest(start, F.col("from"))).otherwise(0)).alias("kept"),
        F.count("leaf").alias("n_leaves"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"),
                                                F.col("q2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    ends = _ends(whole, sequences).join(sequences.select("rep", *KEY), "rep").drop("rep")
    upper = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"),
                         F.col("conv_id").alias("parent_conv_id"))
    zero = F.lit(0).cast("long")
    return (nodes.join(sums, KEY).join(children, KEY, "left").join(ends, KEY, "left")
            .join(upper, ["depth", "q1", "q2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
                    "n_leaves", (F.col("spent") - F.col("kept")).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))


def conversation_trie(conversations: DataFrame, family: int | None = FAMILY, heads: int = HEADS) -> DataFrame:
    """:func:`prefix_trie` of a table of turns (conv_id, turn, role, text), rebuilt by families; None leaves them as they are.

    A null role or text counts as empty. Turns are ordered by turn, null first;
    those of the same number by role and then by the SHA-256 of their content, and repeated rows
    are turns of their own. Rows without conv_id are left out. Other columns are
    not read. An empty table gives an empty result.
    """
    turns = ordered_turns(conversations)
    if family is None:
        ids, turns = turns.select("conv_id").distinct(), turns
    else:
        ids, turns = rebuilt(turns, family, heads)
    return prefix_trie(ids, turns)
