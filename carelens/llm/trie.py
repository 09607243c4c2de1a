"""Prefix trie of conversations: a z-fast trie, built and searched by joins.

A conversation is a sequence of turns (role, text).  Its prefixes are named by
chained 128-bit hashes.  The trie is compacted: a node covers the depths of one
edge, ``top + 1`` to ``depth``, and is found by three hashes: that of its
extent (the prefix at ``depth``), that of its name (the prefix at ``top + 1``)
and that of its handle, the prefix at the two-fattest depth of the edge (the
number there that ends in most zero bits).

* Search.  All conversations look for their exit nodes at once.  A fat binary
  search probes the handle table at the two-fattest depth of what is left of
  (lo, hi]: a hit moves lo to that node's extent, or shows that the
  conversation leaves the trie inside its edge; a miss moves hi below the probe.
  So the number of joins is the logarithm of the longest conversation.  One
  more join, by name, finds the child that a conversation enters without
  reaching its handle.
* Insertion in batches.  A conversation that leaves an edge at depth d splits
  it there.  Of those that go on from the same place with the same turn, one,
  chosen by a hash of its id, is inserted as a leaf; the rest search again in
  the next round, below it.  Conversations that end on the way need no leaf.
  A batch so holds at most one conversation for each new child, whatever the
  data's shape, and a random choice halves what is left below a place about
  every round.
* Subtree sums over the compacted nodes by pointer doubling: each step adds the
  sums of the nodes 2**k edges below and doubles the distance, so the steps are the
  logarithm of the trie's height.
* Edges are expanded last: all depths of an edge have the members of its node.

Places where many conversations meet are join keys with one row on the other
side, which Spark splits, or keys of aggregates that are combined before they
are dealt.  Equal conversations are one sequence; their ids are joined in sorted
ranges and only these pieces meet for the hash.  One conversation's hashes (16
bytes a turn) are held in one row.

Turns are ordered by number, nulls first, ties by a hash of role and text; rows
without a conv_id are left out; null role and text are empty; repeated rows are
turns like any other; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from carelens.llm.shared import cut, pick, stage_memo

ROOT = bytes(16)
_NONE = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with the turns' (turn, digest, words) in order."""
    rows = pick(conversations, conv_id="long", turn="long", role="string", text="string").where("conv_id is not null")
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.size(F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")).cast("long")
    turns = rows.select("conv_id", F.struct("turn", digest.alias("digest"), words.alias("words")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def shared_heads(rows: DataFrame, every: int, most: int) -> DataFrame:
    """Replace the first crc32(conv_id) % ``most`` turns by those of the last conversation divisible by ``every``."""
    heads = rows.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    rows = rows.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": h}).join(heads, "base", "left")
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    return rows.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _chained(rows: DataFrame) -> DataFrame:
    """(conv_id, n, last, chain, cum): hash of every prefix, of the whole, and words up to each turn."""
    names = ["conv_id", "n", "last", "chain", "cum"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]

    def run(batches):
        stage_memo("begun", object)
        for b in (whole.slice(lo, 1000) for whole in batches for lo in range(0, whole.num_rows, 1000)):
            out = []
            for c, digests, words in zip(*(b.column(k).to_pylist() for k in ("conv_id", "digests", "words"))):
                name, total, chain, cum = ROOT, 0, [], []
                for d, w in zip(digests, words):
                    name, total = hashlib.blake2b(name + d, digest_size=16).digest(), total + w
                    chain.append(name)
                    cum.append(total)
                out.append((c, len(chain), name, chain, cum))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names=names)

    rows = rows.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words"))
    return rows.mapInArrow(run, "conv_id long, n int, last binary, chain array<binary>, cum array<bigint>")


def _ends(members: DataFrame) -> DataFrame:
    """(last, own, low, ends) of every distinct sequence: conversations, the smallest, hash of their sorted ids."""
    def pieces(batches):
        stage_memo("begun", object)
        for b in batches:
            last, ids = b.column("last").to_pylist(), b.column("conv_id").to_pylist()
            edges = [0, *(i for i in range(1, len(last)) if last[i] != last[i - 1]), len(last)] if last else [0]
            out = [(last[a], ids[a], ",".join(map(str, ids[a:z])).encode(), z - a) for a, z in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(
                (pa.binary(), pa.int64(), pa.binary(), pa.int64()))], names=["last", "low", "ids", "own"])

    def hashed(batches):
        current, out = None, []

        def close():
            out.append((current[0], current[3], current[1], current[2].hexdigest()))

        def filled():
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(
                (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["last", "own", "low", "ends"])
            out.clear()
            return made

        for b in batches:
            for last, low, ids, own in zip(*(b.column(i).to_pylist() for i in range(4))):
                if current and current[0] == last:
                    current[2].update(b"," + ids)
                    current[3] += own
                else:
                    if current:
                        close()
                    current = [last, low, hashlib.sha256(ids), own]
            yield filled()
        if current:
            close()
        yield filled()

    joined = members.repartitionByRange("last", "conv_id").sortWithinPartitions("last", "conv_id").mapInArrow(
        pieces, "last binary, low long, ids binary, own long")
    return joined.repartition("last").sortWithinPartitions("last", "low").mapInArrow(
        hashed, "last binary, own long, low long, ends string")


def fattest(lo: str, hi: str) -> Column:
    """The two-fattest number of (lo, hi]: the bits of hi down to the highest that differs from lo."""
    return F.expr(f"{hi} & shiftleft(-1, cast(floor(log2({lo} ^ {hi})) as int))")


def _prefix(d: str) -> Column:
    return F.when(F.expr(f"{d} > 0"), F.expr(f"get(chain, {d} - 1)")).otherwise(F.lit(ROOT))


def locate(pending: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """``pending`` (id, n, last, chain) with the deepest node passed (``lo``) and the exit node (``leaving``, or null).

    ``longest`` bounds n.
    """
    apart = F.concat("last", F.lit(b"\0"))  # meets nothing, and spreads the rows that have no question
    rows = pending.withColumns({"lo": F.lit(0), "hi": F.col("n"), "leaving": F.lit(None).cast("binary")})
    handles = nodes.select(F.col("handle").alias("key"), F.col("node").alias("found"), F.col("depth").alias("extent"))
    for _ in range(longest.bit_length() + 1):
        rows = rows.withColumn("f", F.when(F.expr("lo < hi and leaving is null"), fattest("lo", "hi")))
        rows = rows.withColumn("key", F.when(F.col("f").isNotNull(), F.expr("get(chain, f - 1)")).otherwise(apart)).join(handles, "key", "left")
        passed = F.expr("coalesce(get(chain, extent - 1) = found, false)")
        rows = rows.select("id", "n", "last", "chain", F.when(passed, F.col("extent")).otherwise(F.col("lo")).alias("lo"),
                           F.when(F.expr("f is not null and found is null"), F.col("f") - 1).otherwise(F.col("hi")).alias("hi"),
                           F.when(F.col("found").isNotNull() & ~passed, F.col("found")).otherwise(F.col("leaving")).alias("leaving"))
    rows = rows.withColumn("key", F.when(F.expr("leaving is null and lo < n"), F.expr("get(chain, lo)")).otherwise(apart))
    rows = rows.join(nodes.select(F.col("name").alias("key"), F.col("node").alias("child")), "key", "left")
    return rows.select("id", "n", "chain", "lo", F.coalesce("leaving", "child").alias("leaving"))


def _node(rows: DataFrame) -> DataFrame:
    """Nodes (node, parent, name, handle, top, depth, edge, owner) from (parent, top, depth, edge, owner)."""
    rows = rows.withColumn("h", fattest("top", "depth"))
    return rows.select(F.expr("get(edge, depth - top - 1)").alias("node"), "parent", F.expr("get(edge, 0)").alias("name"),
                       F.expr("get(edge, h - top - 1)").alias("handle"), "top", "depth", "edge", "owner")


def build(strings: DataFrame, longest: int) -> DataFrame:
    """The compacted nodes of distinct sequences (id, n, last, chain), without the root."""
    pending = strings.where("n > 0").select("id", "n", "last", "chain")
    empty = pending.limit(0).select(F.lit(ROOT).alias("parent"), F.lit(0).alias("top"), F.lit(1).alias("depth"),
                                    F.col("chain").alias("edge"), F.col("id").alias("owner"))
    nodes = cut(_node(empty))
    while not pending.isEmpty():
        found = cut(locate(pending, nodes, longest))
        edges = nodes.select(F.col("node").alias("leaving"), "top", "depth", "edge")
        inside = found.where("leaving is not null").join(edges, "leaving")
        same = F.expr("top + size(filter(edge, (h, i) -> coalesce(h = get(chain, top + i), false)))")
        inside = inside.withColumn("d", same)
        splits = inside.where("d < depth").groupBy("leaving").agg(F.sort_array(F.collect_set("d")).alias("at"))
        placed = (inside.select("id", "n", "chain", "d")
                  .union(found.where("leaving is null").select("id", "n", "chain", F.col("lo").alias("d"))))
        placed = placed.where("d < n").withColumn("next", F.expr("get(chain, d)"))
        first = placed.groupBy("next").agg(F.min(F.struct(F.xxhash64("id"), "id")).alias("first"))
        first = cut(first.select(F.col("first.id").alias("id")))
        leaves = _node(placed.join(first, "id", "left_semi").select(
            _prefix("d").alias("parent"), F.col("d").alias("top"), F.col("n").alias("depth"),
            F.expr("slice(chain, d + 1, n - d)").alias("edge"), F.col("id").alias("owner")))
        whole = nodes.join(splits.withColumnRenamed("leaving", "node"), "node", "left")
        cuts = F.concat(F.array("top"), F.coalesce("at", F.expr("slice(array(top), 1, 0)")), F.array("depth"))
        whole = whole.withColumn("cuts", cuts).withColumn("i", F.explode(F.expr("sequence(1, size(cuts) - 1)")))
        whole = whole.withColumns({"a": F.expr("get(cuts, i - 1)"), "z": F.expr("get(cuts, i)")})
        parts = _node(whole.select(
            F.when(F.expr("a > top"), F.expr("get(edge, a - top - 1)")).otherwise(F.col("parent")).alias("parent"),
            F.col("a").alias("top"), F.col("z").alias("depth"), F.expr("slice(edge, a - top + 1, z - a)").alias("edge"), "owner"))
        pending = cut(pending.join(placed.select("id").join(first, "id", "left_anti"), "id", "left_semi")
                      .select("id", "n", "last", "chain"))
        nodes = cut(parts.union(leaves))
    return nodes


def subtree_sums(rows: DataFrame, sums: list[str], least: str) -> DataFrame:
    """``rows`` (node, above, ...) with ``sums`` added up and ``least`` minimised over each node's subtree.

    ``above`` is the parent's name, null at the root.
    """
    rows = cut(rows)
    while not rows.where("above is not null").isEmpty():
        below = rows.where("above is not null").groupBy(F.col("above").alias("node")).agg(
            *[F.sum(c).alias(f"more_{c}") for c in sums], F.min(least).alias("lower"))
        added = rows.join(below, "node", "left").select(
            "node", "above", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums], F.least(least, "lower").alias(least))
        further = rows.where("above is not null").select(F.col("node").alias("above"), F.col("above").alias("next"))
        done = F.col("above").isNull() | (F.col("above") == F.lit(ROOT))
        up = added.where(~done).join(further, "above", "left").select("node", F.col("next").alias("above"), *sums, least)
        rows = cut(added.where(done).withColumn("above", F.lit(None).cast("binary")).select("node", "above", *sums, least).union(up))
    return rows.drop("above")


def prefixes(rows: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences (conv_id, turns), the empty one included.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, ended): the
    smallest conversation that starts with it; the same of the prefix one turn shorter; conversations; longer
    prefixes by one turn; prefixes without longer ones that start with it; words of all prefixes that
    start with it times the conversations beyond the first; hash and number of the conversations that end there.
    """
    chains = cut(_chained(rows))
    ends = cut(_ends(chains.select("last", "conv_id")))
    strings = cut(chains.join(ends.select(F.col("low").alias("conv_id")), "conv_id", "left_semi").withColumnRenamed("conv_id", "id"))
    longest = strings.agg(F.max("n")).first()[0] or 0
    nodes = build(strings, longest)

    words = nodes.join(strings.select(F.col("id").alias("owner"), "cum"), "owner").select(
        "node", "parent", "top", "depth", F.expr("slice(cum, top + 1, depth - top)").alias("cum"),
        F.when(F.col("top") > 0, F.expr("get(cum, top - 1)")).otherwise(0).alias("base"))
    root = chains.limit(1).select(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(-1).alias("top"),
                                  F.lit(0).alias("depth"), F.array(F.lit(0).cast("long")).alias("cum"), F.lit(0).cast("long").alias("base"))
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    words = cut(words.union(root).join(ends.withColumnRenamed("last", "node"), "node", "left").join(children, "node", "left")
                .fillna({"own": 0, "n_children": 0, "ends": _NONE}))
    reached = F.expr("get(cum, size(cum) - 1)")
    totals = subtree_sums(words.select(
        "node", F.col("parent").alias("above"), F.col("own").alias("n"), (F.col("own") * reached).alias("sc"),
        (reached - F.col("base")).alias("sw"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), "low"),
        ["n", "sc", "sw", "n_leaves"], "low")
    totals = cut(totals)
    full = words.drop("low").join(totals, "node")
    full = full.join(totals.select(F.col("node").alias("parent"), F.col("low").alias("parent_low")), "parent", "left")
    full = full.withColumn("d", F.explode(F.expr("sequence(top + 1, depth)")))
    before = F.when(F.expr("d > top + 1"), F.expr("get(cum, d - top - 2)")).otherwise(F.col("base"))
    # conversations' words from this turn on, less those of each prefix once
    saved = (F.col("sc") - F.col("n") * before) - (F.col("sw") - (before - F.col("base")))
    here = F.expr("d = depth")
    return full.select(
        F.col("low").alias("conv_id"), F.col("d").cast("long").alias("depth"),
        F.when(F.expr("d = top + 1"), F.col("parent_low")).otherwise(F.col("low")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(here, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", saved.alias("saved_tokens"),
        F.when(here, F.col("ends")).otherwise(F.lit(_NONE)).alias("ends_sha256"),
        F.when(here, F.col("own")).otherwise(0).cast("long").alias("ended"))
