"""The stages on files, against brute force, and the registered queries against SQL."""

import random
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from checks.compare import open_tables
from tests.llm.corpus import awkward, frame, prose, rows
from tests.llm.test_simhash import brute
from tillpath.llm import oracle
from tillpath.llm.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


def write(spark, folder, data, items, clashing=False):
    frame(spark, data, clashing=clashing).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


@pytest.fixture(scope="module", params=[False, True])
def folder(spark, tmp_path_factory, request):
    rng = random.Random(11)
    items = [(i, prose(rng, "en", 30)) for i in range(4)]
    data = rows(12, 150) + [d for d in awkward() if d[0] is None or d[0] >= 1000]
    for i, text in items:
        data.append((2000 + i, prose(rng, "en", 40) + "\n" + text + "\n" + prose(rng, "en", 20), "en", "s1", 9))
    out = tmp_path_factory.mktemp("corpus")
    write(spark, out, data, items, clashing=request.param)
    return out, data


def reread(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_stages_one_by_one(spark, folder, tmp_path):
    where, data = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]
    step = lambda name: reread(spark, stages[name](spark, docs, str(where)), tmp_path / name)

    docs = step("language")
    told = docs.collect()
    assert docs.columns == columns
    ids = {r["doc_id"] for r in told}
    assert set(range(150)) <= ids and not ids & {1000, 1001, 1002, 1004}

    docs = step("near_duplicates")
    assert docs.columns == columns
    # 1005 and the like: whatever is there, one row of each component stays.
    _, _, expected = brute([tuple(r)[:5] for r in told])
    stayed = Counter(r["doc_id"] for r in docs.collect())
    # 1007 has a second text, near the first.
    assert not stayed - Counter(expected) and Counter(expected) - stayed == Counter({1007: 1})

    docs = step("decontamination")
    assert docs.columns == columns
    assert {x for x in expected if x is None or x < 2000} == {r["doc_id"] for r in docs.collect()}

    before = Counter(map(tuple, docs.collect()))
    docs = step("mixing")
    assert docs.columns == columns and Counter(map(tuple, docs.collect())) == before

    order = docs.selectExpr("doc_id", "_metadata.file_name AS f", "_metadata.row_index AS i").orderBy("f", "i")
    place = {r["doc_id"]: n for n, r in enumerate(order.collect())}
    found = stages["sharding"](spark, docs, str(where)).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(k[0] for k in before.elements())
    for shard in range(corpus_pipeline.SHARDS):
        own = sorted((r["slot"], place[r["doc_id"]]) for r in found if r["shard"] == shard)
        assert [s for s, _ in own] == list(range(len(own)))
        assert [p for _, p in own] == sorted(p for _, p in own)


def test_run_equals_the_stages(spark, folder):
    where, data = folder
    found = corpus_pipeline.run(spark, str(where))
    assert {"doc_id", "text", "size", "shard", "slot"} <= set(found.columns)
    ids = [r["doc_id"] for r in found.select("doc_id").collect()]
    # Two texts share the id 1007.
    assert len(ids) <= len(set(ids)) + 1 and not {2000, 2001, 2002, 2003} & set(ids)


def test_a_frame_without_files_is_sharded_too(spark):
    found = corpus_pipeline.sharding(spark, frame(spark, rows(3, 30)), "")
    assert found.count() == 30


def test_empty_documents(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    numbers = {name.split("_")[0] for name in QUERIES} - {"pipeline"}
    assert numbers == {f"op{n}" for n in range(1, 14)}
    assert set(ORACLE_SQL) <= set(QUERIES) and set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    con = open_tables(SMALL)
    answer = con.execute(ORACLE_SQL[name])
    columns = sorted(d[0] for d in answer.description)
    at = {d[0]: i for i, d in enumerate(answer.description)}
    found = QUERIES[name](spark, SMALL)
    assert sorted(found.columns) == columns
    ours = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    theirs = sorted((tuple(r[at[c]] for c in columns) for r in answer.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing_equals_sql_on_uneven_sources(spark, tmp_path, seed):
    rng = random.Random(seed)
    data = [
        (i, "x", "en", rng.choice(["a"] * 20 + ["b"] * 9 + ["c", "d", None]), 1) for i in rng.sample(range(10**6), 3000)
    ]
    frame(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    answer = con.execute(oracle.MIXING)
    columns = [d[0] for d in answer.description]
    found = QUERIES["op3_mixing"](spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(answer.fetchall(), key=repr)


def test_small_queries_run(spark):
    counts = {n: QUERIES[n](spark, SMALL).count() for n in ("op1_sharding", "op4_html_text", "op9_quality")}
    assert counts == {"op1_sharding": 200, "op4_html_text": 50, "op9_quality": 200}

