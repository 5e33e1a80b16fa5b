"""The trie against plain dictionaries of prefixes."""

import hashlib
import random
import re
import zlib

import pytest

from monthwise.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, code string, `a.b` string"


def code(role, text):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return sha(sha(role or "") + sha(text or ""))


def turns_of(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            out.setdefault(conv, []).append((turn is not None, turn or 0, code(role, text), role or "", text or ""))
    return {c: [x[3:] for x in sorted(v)] for c, v in out.items()}


def rebuilt(own):
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def plain(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    words = lambda node: len(re.findall("[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(own) - 1) * words(node)
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own), len(node), parent, len(own), len(children.get(node, ())), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def table(seed, n, longest=9):
    rng = random.Random(seed)
    texts = ["a", "b c", "", None, "d\te f", "a  b c"]
    rows, ids = [], rng.sample(range(-100, 400), n)
    for c in ids:
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(texts[: 1 + t % 6]), "x", "y", "z"))
    rows += [(None, 0, "user", "lost", "x", "y", "z"), (ids[0], None, "user", "first", "x", "y", "z"), (ids[1], 0, "user", "tie", "x", "y", "z"), (ids[1], 0, "user", "tie", "x", "y", "z")]
    long = ids[2]
    rows += [(long, 100 + i, "user", f"w {i % 7}", "x", "y", "z") for i in range(300)]
    rows += [(1000 + k, 100 + i, "user", f"w {i % 7}", "x", "y", "z") for k in range(3) for i in range(200 + 50 * k)]
    return rows


@pytest.mark.parametrize("seed, block, span", [(1, 1024, 4096), (2, 8, 10), (3, 1, 1)])
def test_query_equals_plain_tries(spark, tmp_path, monkeypatch, seed, block, span):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "SPAN", span)
    rows = table(seed, 60)
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(f"{tmp_path}/conversations.parquet")
    want = plain(rebuilt(turns_of(rows)))
    assert rows_of(trie.op11_prefix_trie(spark, str(tmp_path))) == want and len(want) > 300


def test_trie_of_a_table(spark):
    rows = table(4, 80, 5)
    rows += [(2000 + i, t, "user", ("same", "two words", "end")[t], "x", "y", "z") for i in range(50) for t in range(1 + i % 3)]
    got = rows_of(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(7)))
    assert got == plain(turns_of(rows))


def test_conversations_left_without_turns(spark, tmp_path):
    ids = [c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 >= 2][:6]
    rows = [(c, 0, "user", "only one", "x", "y", "z") for c in ids]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = rows_of(trie.op11_prefix_trie(spark, str(tmp_path)))
    assert got == plain(rebuilt(turns_of(rows))) and got == [(min(ids), 0, None, 6, 0, 1, 0, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]


def test_one_turn_and_empty_table(spark, tmp_path):
    assert rows_of(trie.prefix_trie(spark.createDataFrame([(5, 0, "user", "hi", "", "", "")], SCHEMA))) == plain({5: [("user", "hi")]})
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert trie.op11_prefix_trie(spark, str(tmp_path)).count() == 0
