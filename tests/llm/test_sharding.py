import heapq
import zlib
from collections import Counter, defaultdict

from monthwise.llm.sharding import assign_shards, schedule

SCHEMA = "doc_id long, text string, shard string, extra int"


def rows():
    out = [(i, "word " * (1 + i * i % 97), "old", i) for i in range(300)]
    out += [(1000 + i, "same text", "old", i) for i in range(200)] + [(None, None, None, 0), (1, None, None, 0), (2, "", None, 0), (2, "", None, 0)]
    return out + [(5000, "x" * 300_000, "long", 1)]


def test_groups_slots_and_sizes(spark):
    got = assign_shards(spark.createDataFrame(rows(), SCHEMA), 4).collect()
    assert len(got) == len(rows())
    groups, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        data = r.text.encode() if r.text is not None else b""
        assert r["size"] == len(data) + 1 and r.text_crc32 == (zlib.crc32(data) if r.text is not None else None)
        groups[r.text].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(len(g) == 1 for g in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter()
    for r in got:
        sizes[r.text] += r["size"]
    heap = [0] * 4
    for s in sorted(sizes.values(), reverse=True):
        heapq.heappush(heap, heapq.heappop(heap) + s)
    assert max(load.values()) == max(heap)


def test_bundles_keep_near_equal_sizes(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "repeat('ab ', cast(1 + id % 50 as int)) || id as text", "'s' as shard", "1 as extra")
    load = Counter()
    for r in assign_shards(df, 4, grain=16).collect():
        load[r.shard] += r["size"]
    assert max(load.values()) < 1.02 * min(load.values())


def test_largest_first_and_empty(spark):
    placed = schedule([(8, 1), (7, 2), (6, 3), (5, 4), (4, 5)], 2)
    assert placed[1] != placed[2] and placed[3] == placed[2]
    assert assign_shards(spark.createDataFrame([], SCHEMA)).count() == 0
