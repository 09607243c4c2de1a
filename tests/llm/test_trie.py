"""op11: the z-fast trie against a plain trie of nested dictionaries."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from carelens.llm import queries, trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(conversations):
    """{prefix: row} of conversations {conv_id: [(role, text), ...]}."""
    members, ending = defaultdict(list), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ending[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = sum(saved[c] for c in children[p]) + (len(members[p]) - 1) * words
    return sorted((min(members[p]), len(p), min(members[p[:-1]]) if p else -1, len(members[p]), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ending[p]))).encode()).hexdigest()) for p in members)


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((-1 if turn is None else turn, role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(turns, key=lambda x: x[0])] for c, turns in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    return out


def found(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in df.collect())


def sequences(spark, conversations):
    rows = [(c, i, r, t) for c, turns in conversations.items() for i, (r, t) in enumerate(turns)]
    return trie.sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def shapes():
    rng = random.Random(4)
    say = lambda *xs: [("user", x) for x in xs]
    yield "random", {c: say(*(rng.choice("abc") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 9)))) for c in range(150)}
    yield "chain", {c: say(*(f"turn {i}" for i in range(c + 1))) for c in range(40)}  # each one turn longer
    yield "comb", {c: say(*(f"turn {i}" for i in range(c)), f"end of {c}", "x") for c in range(40)}
    yield "equal", {c: say("a b", "c") for c in range(50)} | {99: say("a b", "c", "d e f")}
    yield "star", {c: say("hello there", f"own {c}") for c in range(60)}
    yield "one", {7: say("only one")}
    yield "roles", {1: [("user", "a")], 2: [("assistant", "a")], 3: [("", "usera")], 4: [("user", "a"), ("", "")], 5: [("user", "a"), ("", " \t")]}


@pytest.mark.parametrize("name,conversations", list(shapes()))
def test_prefixes_equal_plain_trie(spark, name, conversations):
    assert found(trie.prefixes(sequences(spark, conversations))) == plain_trie(conversations)


def test_query_on_odd_rows(spark, workdir):
    rng = random.Random(9)
    rows = [(c, i, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hi there", None, "", "  ", "long " * 4000, "Ü x\x1cy"]))
            for c in rng.sample(range(100), 60) for i in range(rng.randrange(1, 6))]
    rows += [(c, i, "user", "same") for c in (200, 201, 203, 207, 220, 221) for i in range(3)]
    rows += [(300, None, "user", "first"), (300, 0, "user", "second"), (302, -5, "u", "x"), (302, None, "u", "y")]
    rows += [(None, 0, "user", "no id"), (None, None, None, None), (405, 3, "user", "twice"), (405, 3, "user", "twice"), (419, 0, "u", "far")]
    schema = "conv_id long, turn long, role string, text string"
    given = spark.createDataFrame(rows, schema).withColumns({"depth": F.lit(5), "n": F.lit("x"), "chain": F.lit(1)})
    for name, table, want in (("full", given, plain_trie(plain_rebuilt(rows))), ("none", given.limit(0), [])):
        table.write.parquet(f"{workdir}/{name}/conversations.parquet")
        assert found(queries.QUERIES["op11_conversation_trie"](spark, f"{workdir}/{name}")) == want


def test_turnless_conversations_are_members_of_the_root(spark):
    rows = [(c, 0, "user", "only") for c in range(21, 40)]  # their base, 20, is absent
    got = found(trie.prefixes(trie.shared_heads(trie.sequences(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), 20, 4)))
    want = plain_rebuilt(rows)
    assert any(not turns for turns in want.values()) and got == plain_trie(want)


def test_clashing_column_names_are_ignored(spark):
    given = spark.createDataFrame([(1, 0, "user", "a", "b", 2)], "conv_id long, turn long, role string, text string, Text string, TURN int")
    assert found(trie.prefixes(trie.sequences(given))) == plain_trie({1: [("user", "a")]})


def test_two_fattest_number(spark):
    pairs = [(a, b) for a in range(0, 70) for b in range(a + 1, 70)] + [(-1, 0)]
    got = spark.createDataFrame(pairs, "a int, b int").select("a", "b", trie.fattest("a", "b").alias("f")).collect()
    for a, b, f in got:
        if a >= 0:
            assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_every_node_is_found_by_its_handle(spark):
    """Searches of sequences already in the trie end at their own nodes."""
    conversations = dict(shapes())["random"]
    chains = trie._chained(sequences(spark, conversations)).cache()
    strings = chains.groupBy("last").agg(F.min_by(F.struct(F.col("conv_id").alias("id"), "n", "chain"), "conv_id").alias("s")).select("s.*", "last")
    nodes = trie.build(strings, 9)
    assert nodes.select("handle").distinct().count() == nodes.count() == nodes.select("name").distinct().count()
    rows = trie.locate(strings.select("id", "n", "last", "chain"), nodes, 9).collect()
    assert all(r.lo == r.n and r.leaving is None for r in rows)
