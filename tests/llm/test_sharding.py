import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.corpus import SCHEMA, awkward, frame, rows
from tillpath.llm.sharding import pack, shard_documents


def test_pack_balances_every_dimension():
    items = [(i, (float(100 - i), float(1 + i % 7), 1.0)) for i in range(96)]
    placed = pack(items, 4)
    for d in range(3):
        sums = Counter()
        for key, vector in items:
            sums[placed[key]] += vector[d]
        assert max(sums.values()) < 1.1 * sum(sums.values()) / 4


def test_packs_where_the_dot_product_is_highest():
    # After the two large items, the row-heavy one fits best beside the byte-heavy one.
    items = [("a", (8.0, 1.0, 1.0)), ("b", (1.0, 8.0, 8.0)), ("c", (0.5, 4.0, 4.0)), ("d", (4.0, 0.5, 0.5))]
    placed = pack(items, 2)
    assert placed["c"] == placed["a"] and placed["d"] == placed["b"]


@pytest.mark.parametrize("clashing", [False, True])
def test_every_row_gets_a_place(spark, clashing):
    data = awkward()
    docs = frame(spark, data, clashing=clashing)
    found = shard_documents(docs, 4).collect()
    assert len(found) == len(data)
    slots = defaultdict(list)
    for r in found:
        text = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text))
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_equal_texts_stay_together_and_sizes_are_near(spark):
    data = rows(5, 400)
    found = shard_documents(frame(spark, data), 4).collect()
    shards = defaultdict(set)
    sizes = Counter()
    for r in found:
        shards[r["text"]].add(r["shard"])
        sizes[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in shards.values())
    assert max(sizes.values()) < 1.1 * min(sizes.values())


def test_a_group_beyond_a_shard_is_cut(spark):
    data = [(i, "same old words" if i % 3 else f"words of number {i}", "en", "s", 1) for i in range(600)]
    found = shard_documents(frame(spark, data), 8)
    sizes = [r["n"] for r in found.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.35 * min(sizes)


def test_slots_follow_a_given_order(spark):
    docs = frame(spark, rows(3, 200)).withColumn("turn", 1000 - F.col("doc_id"))
    found = shard_documents(docs, 4, order=F.col("turn")).collect()
    for shard in range(4):
        ids = [r["doc_id"] for r in sorted(found, key=lambda r: r["slot"]) if r["shard"] == shard]
        assert ids == sorted(ids, reverse=True)


def test_empty_table(spark):
    assert shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0
