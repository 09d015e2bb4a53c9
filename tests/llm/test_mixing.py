from collections import Counter, defaultdict

import pytest

from tests.llm.corpus import SCHEMA, awkward, frame, rows
from tillpath.llm.mixing import mix, schedule_sql, units_of, whole_units


@pytest.mark.parametrize("weights", [[1], [1, 1], [5, 3, 2], [100, 1, 1, 1], [1] * 7, list(range(1, 21))])
def test_each_block_lies_between_release_and_deadline(spark, weights):
    units = units_of(weights, 100)
    assert sum(units) == 100 and min(units) >= 1
    lanes = spark.range(1).selectExpr(schedule_sql(units, 100) + " AS s").first()["s"]
    seen = Counter()
    for t, lane in enumerate(lanes):
        j, u = seen[lane], units[lane]
        assert j * 100 // u <= t < -(-(j + 1) * 100 // u)
        seen[lane] += 1
        assert all(abs(seen[i] - (t + 1) * x / 100) < 1 for i, x in enumerate(units))
    assert [seen[i] for i in range(len(units))] == units


def test_sources_stay_within_a_block_of_their_weights(spark):
    data = [(i, "x", "en", "abc"[i % 3], 1) for i in range(900)]
    found = mix(frame(spark, data), {"a": 5, "b": 3, "c": 2}, block_rows=4, period=10).collect()
    assert sorted(r["position"] for r in found) == list(range(900))
    order = [r["source"] for r in sorted(found, key=lambda r: r["position"])]
    first = order[:600]  # all sources last at least so long
    for t in range(4, 600, 4):
        seen = Counter(first[:t])
        assert all(abs(seen[s] - t * w) < 4 for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))


@pytest.mark.parametrize("lanes", [256, 2])
@pytest.mark.parametrize("clashing", [False, True])
def test_no_row_is_lost(spark, lanes, clashing):
    data = awkward()
    found = mix(frame(spark, data, clashing=clashing), block_rows=2, lanes=lanes).collect()
    assert sorted(r["position"] for r in found) == list(range(len(data)))
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter((d[0], d[1]) for d in data)
    ranks = defaultdict(list)
    for r in found:
        assert r["release"] <= r["slot"] < r["deadline"]
        ranks[r["lane"]].append(r["block"])
    for blocks in ranks.values():
        sizes = Counter(blocks)
        assert sorted(sizes) == list(range(len(sizes)))
        assert all(sizes[b] == 2 for b in range(len(sizes) - 1))


@pytest.mark.parametrize(
    "weights, units",
    [([2, 1], [2, 1]), ([0.5, 0.3, 0.2], [5, 3, 2]), ([4, 6], [2, 3]), ([1e-3, 1], [1, 1000]), ([1 / 3, 2 / 3], [1, 2]), ([0.12345, 1], None), ([7], [1])],
)
def test_whole_units(weights, units):
    assert whole_units(weights, 10_000) == units


def test_given_weights_do_not_drift(spark):
    data = [(i, None, "en", "b" if i % 3 == 0 else "a", 1) for i in range(30_000)]
    found = mix(frame(spark, data), {"a": 2, "b": 1}, block_rows=1).select("position", "source").collect()
    seen = Counter()
    for t, r in enumerate(sorted(found, key=lambda r: r["position"]), 1):
        seen[r["source"]] += 1
        assert abs(3 * seen["a"] - 2 * t) < 3


def test_more_given_weights_than_slots(spark):
    data = [(i, None, "en", f"s{i % 300}", 1) for i in range(900)]
    found = mix(frame(spark, data), {f"s{i}": 1 + i % 3 / 7 for i in range(300)}, block_rows=1, period=10).collect()
    assert sorted(r["position"] for r in found) == list(range(900))
    assert len({r["lane"] for r in found}) == 300


def test_unlisted_sources_share_a_lane(spark):
    found = mix(frame(spark, rows(3, 80)), {"big": 1.0}, period=10).collect()
    assert {r["lane"] for r in found if r["source"] == "big"} == {0}
    assert {r["lane"] for r in found if r["source"] != "big"} == {1}


def test_bad_weights(spark):
    with pytest.raises(ValueError):
        mix(frame(spark, rows(3, 5)), {"big": 0.0})
    with pytest.raises(ValueError):
        units_of([1.0] * 11, 10)


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
