"""Prefix trie of conversations, by whole-sequence collapse.

Conversations are rebuilt from a shared head and their own turns. Every prefix of a rebuilt conversation has a
128-bit signature, the exclusive or of the hashes of its turns with their places, so that signatures of
all prefixes are running values, and long conversations may be cut into blocks and added up. Equal whole
conversations collapse into one weighted sequence with a list of those that end there; the sequences that are proper
prefixes of others fall to an anti-join, which leaves the leaves. Nodes are the distinct prefixes of the weighted
sequences, and all their figures are sums over the sequences that pass through:

* members and leaves are sums of weights and of leaves;
* the conversations' code points below a node are a sequence's total less what stands above the node, times its weight;
* for the code points of the nodes below (each counted once) a node belongs to the smallest conversation through it.
  That conversation owns all deeper nodes of its path as well, so that a sequence adds what it owns there.

No node's subtree is walked. Sums are combined before the shuffle, so that a node through which all conversations pass
is no hot key; a conversation of any length is dealt out over range partitions and blocks of ``BLOCK`` turns.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sellerlens.llm.shared import parts_for, ship_code, stored, total

HEADS, GROUP = 6, 100    # a head has less than HEADS turns, of the first conversation of every GROUP ids
BLOCK = 4096             # turns of a conversation that a window takes at once
ID_BITS = 12             # ends of a sequence are gathered by 2**ID_BITS neighbouring ids
KEY = ["depth", "px", "py"]


def head_length(conv):
    """Turns a conversation takes from its group's first one."""
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int")


def numbered(
    table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", with_text: bool = True
) -> DataFrame:
    """``conv, place, chars, x, y``, ``role`` and ``text`` too if asked for: turns by their place (from 1) in their conversation.

    Turns without a number come first; turns that share a number follow in order of role and text. Null
    roles and texts are empty; rows without a conversation are left out. A range partition's rows are in order, so that
    a place is that of the row in its partition plus what the conversation has in partitions before it.
    """
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = table.select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
        empty(role).alias("role"), empty(text).alias("text"),
    ).where("conv IS NOT NULL")
    parts = parts_for(total(rows, F.length("text") + 40), 32_000_000)
    order = ["conv", F.asc_nulls_first("turn"), "role", "text"]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    kept = ["role", "text"] if with_text else []
    placed = stored(placed.select(
        "conv", *kept, "at", F.shiftright("at", 33).alias("part"), F.length("text").cast("long").alias("chars"),
        F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit("turn"), "role", "text").alias("y"),
    ), "turns")
    runs = placed.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")
    runs = runs.select("conv", "part", (F.col("first") - before).alias("zero"))
    return placed.join(runs, ["conv", "part"]).select(
        "conv", (F.col("at") - F.col("zero") + 1).alias("place"), *kept, "chars", "x", "y"
    )


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv, depth`` and the other columns of ``numbered``: the turns of rebuilt conversations, of those that have any.

    A conversation begins with the first turns of its group's first conversation, as many as ``head_length``
    says and there are, and goes on with its own turns after as many of its own. Groups are of ids with the same
    quotient by ``GROUP``, rounded down.
    """
    group = lambda c: F.col(c) - F.pmod(F.col(c), F.lit(GROUP))
    columns = [c for c in turns.columns if c not in ("conv", "place")]
    heads = turns.where((F.pmod("conv", F.lit(GROUP)) == 0) & (F.col("place") < HEADS))
    sizes = heads.groupBy(F.col("conv").alias("base")).agg(F.max("place").alias("there"))
    convs = turns.where("place = 1").select("conv", head_length(F.col("conv")).alias("h"), group("conv").alias("base"))
    convs = convs.join(sizes, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"))
    shared = heads.withColumnRenamed("conv", "base").join(convs, "base").where("place <= taken")
    shared = shared.select("conv", F.col("place").alias("depth"), *columns)
    own = turns.join(convs, "conv").where("place > h").select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), *columns)
    return shared.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv, depth, px, py, ax, ay, chars, upto``: signatures of the prefix up to a turn and of the one before it, and code points up to it."""
    mixed = turns.select(
        "conv", "depth", "chars", F.floor(F.col("depth") / BLOCK).alias("block"),
        F.xxhash64("x", "y", "depth").alias("hx"), F.xxhash64("y", "depth", "x").alias("hy"),
    )
    so_far = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    within = mixed.select(
        "*", F.bit_xor("hx").over(so_far).alias("px"), F.bit_xor("hy").over(so_far).alias("py"), F.sum("chars").over(so_far).alias("upto")
    )
    blocks = mixed.groupBy("conv", "block").agg(F.bit_xor("hx").alias("bx"), F.bit_xor("hy").alias("by"), F.sum("chars").alias("b"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "conv", "block", F.bit_xor("bx").over(earlier).alias("bx"), F.bit_xor("by").over(earlier).alias("by"), F.sum("b").over(earlier).alias("b")
    ).where("block > 0")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    whole = within.join(blocks, ["conv", "block"], "left").select(
        "conv", "depth", "chars", F.col("hx"), F.col("hy"), F.col("px").bitwiseXOR(zero("bx")).alias("px"),
        F.col("py").bitwiseXOR(zero("by")).alias("py"), (F.col("upto") + zero("b")).alias("upto"),
    )
    return whole.select(
        "conv", "depth", "px", "py", F.col("px").bitwiseXOR(F.col("hx")).alias("ax"), F.col("py").bitwiseXOR(F.col("hy")).alias("ay"), "chars", "upto"
    )


def collapsed(paths: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole conversations by their signature: ``(members, sequences)``.

    ``members`` has one row per conversation (``conv`` and the node ``depth, px, py`` it ends at, the root for one without
    turns), ``sequences`` one row per distinct whole conversation: its node, ``rep`` (smallest conversation), ``weight``
    and ``chars``.
    """
    last = paths.groupBy("conv").agg(F.max(F.struct("depth", "px", "py", "upto")).alias("end"))
    zero = lambda c, kind="long": F.coalesce(F.col(f"end.{c}"), F.lit(0)).cast(kind).alias(c)
    members = stored(convs.join(last, "conv", "left").select("conv", zero("depth"), zero("px"), zero("py"), zero("upto")), "members")
    sequences = members.groupBy(*KEY).agg(F.min("conv").alias("rep"), F.count("*").alias("weight"), F.max("upto").alias("total"))
    return members, stored(sequences, "sequences")


def _streamed_hashes(batches):
    """SHA-256 of each node's joined ids, from pieces that arrive in order; one hash is open at a time."""
    node, state = None, None
    out = []
    for batch in batches:
        for d, px, py, ids in zip(batch["depth"], batch["px"], batch["py"], batch["ids"], strict=True):
            if (d, px, py) != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (d, px, py), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
        out = []
    if node is not None:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=[*KEY, "ends_sha256"])


def end_lists(members: DataFrame) -> DataFrame:
    """``depth, px, py, part, ids``: the conversations that end at a node, ascending and joined by commas, in parts of neighbouring ids."""
    return members.groupBy(*KEY, F.shiftright("conv", ID_BITS).alias("part")).agg(
        F.array_join(F.array_sort(F.collect_list("conv")), ",").alias("ids")
    )


def end_hashes(members: DataFrame) -> DataFrame:
    """``depth, px, py, ends_sha256`` of the nodes where conversations end.

    A hash runs over its ids one after the other. Ids are joined in parts before the shuffle, and a hot
    node's parts are read in order without being held.
    """
    ship_code(members.sparkSession)
    lists = end_lists(members)
    single = lists.repartition(*KEY).sortWithinPartitions(*KEY, "part").drop("part")
    return single.mapInPandas(_streamed_hashes, "depth long, px long, py long, ends_sha256 string")


def trie(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    A node is a distinct sequence of the first turns of rebuilt conversations, down from the root without turns; it
    is named by its smallest conversation and its depth. ``with_text`` adds ``role`` and ``text`` of its last
    turn. Conversations without turns end at the root. Repeated rows are repeated turns. Other columns aren't looked
    at. A table without conversations has no nodes. Two different prefixes count as one with a probability of 2**-128.
    """
    turns = stored(numbered(table, conv, turn, role, text, with_text), "numbered")
    convs = turns.where("place = 1").select("conv")
    whole = stored(rebuilt(turns), "rebuilt")
    paths = stored(prefixes(whole), "prefixes")
    members, sequences = collapsed(paths, convs)

    names = sequences.select(F.col("rep").alias("conv"), "weight", "total", F.col("depth").alias("length"))
    root = sequences.select(
        F.col("rep").alias("conv"), F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("px", "py", "ax", "ay", "chars", "upto")],
        "weight", "total", F.col("depth").alias("length"),
    )
    weighted = stored(paths.join(names, "conv").unionByName(root), "weighted")

    nodes = stored(weighted.groupBy(*KEY).agg(
        F.min("conv").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max(F.col("depth") < F.col("length")).alias("inner"),
        F.max("ax").alias("ax"), F.max("ay").alias("ay"), F.max(F.col("upto") - F.col("chars")).alias("above"),
    ), "nodes")
    leaves = sequences.join(nodes.where("inner"), KEY, "left_anti").select(F.col("rep").alias("conv"), F.lit(1).cast("long").alias("leaf"))
    owned = nodes.groupBy(F.col("conv_id").alias("conv")).agg(F.min(F.struct("depth", "above")).alias("top"))
    owned = owned.select("conv", F.col("top.depth").alias("first"), F.col("top.above").alias("above_first"))
    marks = stored(
        sequences.select(F.col("rep").alias("conv")).join(leaves, "conv", "left").join(owned, "conv", "left"), "marks"
    )
    here = F.col("upto") - F.col("chars")
    own = F.when(F.col("first").isNull(), 0).when(F.col("depth") < F.col("first"), F.col("total") - F.col("above_first")).otherwise(F.col("total") - here)
    sums = weighted.join(marks, "conv").groupBy(*KEY).agg(
        F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum(F.col("weight") * (F.col("total") - here) - own).alias("saved_tokens")
    )
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("ax").alias("px"), F.col("ay").alias("py")).agg(
        F.count("*").alias("n_children")
    )
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("px").alias("ax"), F.col("py").alias("ay"), F.col("conv_id").alias("parent_conv_id"))
    out = (
        nodes.join(sums, KEY).join(children, KEY, "left").join(end_hashes(members), KEY, "left").join(parents, ["depth", "ax", "ay"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
    if not with_text:
        return out
    last = whole.select(F.col("conv").alias("conv_id"), "depth", "role", "text")
    return out.join(last, ["conv_id", "depth"], "left")
