"""Conversation prefix trie, rolled up by pointer jumping.

A node is a distinct sequence of first turns. Its key is a digest that adds up along a conversation, so that prefixes of
any length come from running sums over bounded parts; its parent's key is the same sum without the last turn. Leaves and
savings reach all ancestors in doubling rounds: after round k a node holds its subtree down to 2^k levels, and hands that to
its 2^k-th ancestor. Rounds grow with the logarithm of the depth, and each works only on nodes that are deep enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

#: First turns of a base conversation that the branches of ``branched`` can take over.
MOST_SHARED = 5
#: Ids whose decimal texts are joined at once for a node's digest of ends.
CHUNK = 4096
KEY = ["depth", "a", "b"]


def ordered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, part, depth, said, chars): the turns of each conversation from depth 1 in the order of ``turn`` (null
    first), ``said`` a 128-bit digest of role and text, ``chars`` the text's code points.

    Null roles and texts are empty. Equal turn numbers follow the order of role, then of ``said``; repeated rows are turns
    of their own. Rows without a conversation id belong to none and are left out. Texts of any length are digested where
    they lie and not moved. Other columns are left behind, whatever their names.

    Rows are dealt by ranges of all sorting columns, so that a conversation of any length spreads over parts; a part's turns
    are numbered where they are, and what precedes it in a conversation that crosses parts is added from the parts' counts.
    """
    who = F.coalesce(F.col(role).cast("string"), F.lit(""))
    what = F.coalesce(F.col(text).cast("string"), F.lit(""))
    said = F.unhex(F.substring(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, what).cast("binary"), 256), 1, 32))
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), who.alias("role"), said.alias("said"),
        F.length(what).cast("long").alias("chars"), F.rand(5).alias("spread"),
    )
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("said").asc(), F.col("spread").asc()]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            if not len(ids):
                continue
            starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            at = np.arange(1, len(ids) + 1) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
            if ids[0] == last:
                at[: starts[1] if len(starts) > 1 else len(ids)] += count
            last, count = ids[-1], int(at[-1])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(at.astype(np.int64)), batch.column("said"), batch.column("chars")], names=["conv_id", "part", "depth", "said", "chars"])

    rows = materialise(rows, "said")  # ranges are sampled first, which would digest every text twice
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, "conv_id long, part int, depth long, said binary, chars long")
    turns = materialise(dealt, "turns")
    counts = turns.groupBy("conv_id", "part").agg(F.max("depth").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.sum("n").over(before)).where(F.col("before") > 0).select("conv_id", "part", "before")
    return turns.join(offsets, ["conv_id", "part"], "left").select("conv_id", "part", (F.col("depth") + F.coalesce("before", F.lit(0))).alias("depth"), "said", "chars")


def branched(turns: DataFrame, base: Column, shared: Column) -> tuple[DataFrame, DataFrame]:
    """The turns and the ids of the conversations rebuilt as branches: the first ``shared`` turns (at most MOST_SHARED; an
    expression of ``conv_id``) of the conversation ``base`` (all if it has fewer, none if there is no such conversation),
    then the own turns after the first ``shared``, if any. A base must be its own base.

    A base is read for its first turns alone, and hands them as digests to its branches, so nothing grows with the length
    of a text or of a conversation.
    """
    turns = materialise(turns, "numbered")
    blocks = turns.groupBy("conv_id", "part").agg(F.max("depth").alias("last"))
    ids = blocks.select("conv_id").distinct().withColumns({"base": base, "shared": shared})
    heads = turns.where((F.col("depth") <= MOST_SHARED) & (base == F.col("conv_id"))).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("depth", "said", "chars"))).alias("head"))
    ids = materialise(ids.join(heads, "base", "left").select("conv_id", "shared", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("shared")).alias("head")), "branches")
    taken = ids.select("conv_id", F.lit(-1).alias("part"), F.explode("head").alias("h")).select("conv_id", "part", "h.depth", "h.said", "h.chars")
    shift = blocks.select("conv_id", "part").join(ids.select("conv_id", "shared", F.size("head").alias("taken")), "conv_id")
    own = turns.join(shift, ["conv_id", "part"]).where(F.col("depth") > F.col("shared")).select("conv_id", "part", (F.col("depth") - F.col("shared") + F.col("taken")).alias("depth"), "said", "chars")
    return taken.unionByName(own), ids.select("conv_id")


def _prefixes(turns: DataFrame) -> DataFrame:
    """Each turn with the key of the prefix that ends there (a, b), of the one before (up_a, up_b), and whether its
    conversation ends there: running sums (exclusive or, of hashes of depth and turn) over each part's turns, and over the
    parts of conversations that have several."""
    hashed = turns.withColumns({x: F.xxhash64(F.lit(x), "depth", "said") for x in ("ha", "hb")})
    running = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = materialise(hashed.select("conv_id", "part", "depth", "chars", "ha", "hb", F.bit_xor("ha").over(running).alias("a"), F.bit_xor("hb").over(running).alias("b")), "sums")
    parts = summed.groupBy("conv_id", "part").agg(F.bit_xor("ha").alias("ha"), F.bit_xor("hb").alias("hb"), F.max("depth").alias("last"))
    before, whole = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("conv_id")
    parts = parts.select("conv_id", "part", F.coalesce(F.bit_xor("ha").over(before), F.lit(0)).alias("da"), F.coalesce(F.bit_xor("hb").over(before), F.lit(0)).alias("db"), F.max("last").over(whole).alias("last"))
    a, b = F.col("a").bitwiseXOR(F.col("da")), F.col("b").bitwiseXOR(F.col("db"))
    return summed.join(parts, ["conv_id", "part"]).select(
        "conv_id", F.col("depth").cast("int").alias("depth"), a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("ha")).alias("up_a"), b.bitwiseXOR(F.col("hb")).alias("up_b"), "chars",
        (F.col("depth") == F.col("last")).alias("ended"),
    )


def _ends(ended: DataFrame) -> DataFrame:
    """The digest of each node's ended conversations. Ids are ordered by ranges, joined to texts of at most CHUNK ids, and
    the texts streamed through SHA-256 in order: no list is ever held, and a node with very many ends sends one row for
    each CHUNK of them. The digest itself is defined from first to last id, so a node's texts do pass one task."""
    schema = "depth int, a long, b long, first long, ids string"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        now = None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv_id")), strict=True):
                if held and (row[:3] != now or len(held) == CHUNK):
                    out.append((*now, held[0], ",".join(map(str, held))))
                    held = []
                now = row[:3]
                held.append(row[3])
            yield _batch(out, [*KEY, "first", "ids"], _TEXTS)
        yield _batch([(*now, held[0], ",".join(map(str, held)))] if held else [], [*KEY, "first", "ids"], _TEXTS)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if row[:3] != now:
                    if sha:
                        out.append((*now, sha.hexdigest()))
                    now, sha = row[:3], hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(row[3].encode())
            yield _batch(out, [*KEY, "ends_sha256"], _DIGESTS)
        yield _batch([(*now, sha.hexdigest())] if sha else [], [*KEY, "ends_sha256"], _DIGESTS)

    order = [*KEY, "conv_id"]
    texts = ended.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, schema)
    return texts.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, "depth int, a long, b long, ends_sha256 string")


_TEXTS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
_DIGESTS = [pa.int32(), pa.int64(), pa.int64(), pa.string()]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """(depth, a, b, n_leaves, saved_tokens) over each node's subtree, from nodes with their parent's key (up_a, up_b), leaf
    flag and savings. In round k the nodes of depth 2^k or more hand what they hold to their 2^k-th ancestors; what a node
    gets is summed before the shuffle, also for the root, and pointers double by one join. A node is in a round only while
    it has such an ancestor, so tables shrink to the deepest nodes."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    live = nodes.where(F.col("depth") >= 1).select(*KEY, "up_a", "up_b", F.col("leaf").alias("leaves"), "saved")
    own = nodes.select(*KEY, F.col("leaf").alias("leaves"), "saved")
    got, step, held = [own], 1, None
    while step <= deepest:
        sums = live.groupBy((F.col("depth") - step).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        sums = materialise(sums, "handed")
        got.append(sums)
        if 2 * step <= deepest:
            far = live.where(F.col("depth") >= 2 * step)
            over = live.select((F.col("depth") + step).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("up_a").alias("over_a"), F.col("up_b").alias("over_b"))
            more = sums.where(F.col("depth") >= 2 * step).select(*KEY, F.col("leaves").alias("more"), F.col("saved").alias("more_saved"))
            following = far.join(over, ["depth", "up_a", "up_b"]).join(more, KEY, "left").select(
                *KEY, F.col("over_a").alias("up_a"), F.col("over_b").alias("up_b"), (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")
            )
            live = materialise(following, "jumped")
            if held is not None:
                discard(held)
            held = live
        step *= 2
    every = got[0]
    for sums in got[1:]:
        every = every.unionByName(sums)
    return every.groupBy(*KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def rollup(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The trie of ``turns`` (as of ``ordered_turns`` or ``branched``), one row a node: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the node's key a, b.

    The root (depth 0) has every conversation of ``ids`` (default: those with turns) as a member, also those without turns.
    Without any conversation there is no node, not even a root. saved_tokens counts code points of a node's last text for
    each member but one, over the subtree. Keys of 128 bits are taken for the sequences that they stand for.
    """
    members = _prefixes(turns).select("conv_id", *KEY, "up_a", "up_b", "chars", "ended")
    members = materialise(members, "members")
    if ids is None:
        ids = turns.select("conv_id").distinct()
    started = members.where(F.col("depth") == 1).select("conv_id").withColumn("started", F.lit(True))
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    roots = ids.join(started, "conv_id", "left").select("conv_id", F.lit(0).alias("depth"), zero.alias("a"), zero.alias("b"), none.alias("up_a"), none.alias("up_b"), zero.alias("chars"), F.col("started").isNull().alias("ended"))
    every = members.unionByName(roots)
    found = every.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"))
    found = materialise(found, "found")
    children = found.where(F.col("depth") > 0).groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = found.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = materialise(nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")}), "nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        nodes.join(parents, ["depth", "up_a", "up_b"], "left")
        .join(_subtree_sums(nodes), KEY)
        .join(_ends(every.where("ended")), KEY, "left")
        .select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"), "a", "b")
    )


def trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The prefix trie of a table of conversations; see ``ordered_turns`` for nulls, ties, repeated rows and other columns,
    and ``rollup`` for what comes back. An empty table gives no rows."""
    return rollup(ordered_turns(conversations, conv_id, turn, role, text))
