import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.corpus import SCHEMA, awkward, frame, prose, rows
from tillpath.llm.minhash import Sets, forest, likely, near_duplicates, near_to_kept, row_key, shingles, similar


def plain_set(text):
    words = (text or "").encode().lower().split()
    run = min(3, len(words))
    return {tuple(words[i : i + run]) for i in range(len(words) - run + 1)} if run else set()


def brute(data, percent=85):
    """Each row's set size and least id of its class."""
    sets = [plain_set(r[1]) for r in data]
    root = list(range(len(data)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    ids = {}
    for i, r in enumerate(root):
        known = [x for x in (ids.get(r), data[i][0]) if x is not None]
        ids[r] = min(known) if known else None
    # Rows without words are linked with nothing.
    return [(len(s), ids[r] if s else d[0]) for s, r, d in zip(sets, root, data)]


def check(spark, data, clashing=False, **options):
    found = near_duplicates(frame(spark, data, clashing=clashing), **options).collect()
    order = lambda x: tuple((y is None, y or 0) for y in x)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found), key=order)
    want = [(d[0], n, c, c == d[0]) for d, (n, c) in zip(data, brute(data, options.get("percent", 85)))]
    assert got == sorted(want, key=order)


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        at, kind = rng.randrange(len(words)), rng.randrange(4)
        if kind == 0:
            words[at] = f"new{rng.randrange(10**6)}"
        elif kind == 1:
            del words[at : at + rng.randint(1, 6)]
        elif kind == 2:
            words[at:at] = [f"more{rng.randrange(10**6)}" for _ in range(rng.randint(1, 6))]
        else:
            words += words[at : at + 4]
    return words


def families(seed, groups, members, lengths=(8, 20, 60, 200, 900)):
    """Families of edited copies, so that similarities lie all around the bound; half of them share a passage."""
    rng = random.Random(seed)
    passage = prose(rng, "fr", 60).split()
    data = []
    for group in range(groups):
        words = prose(rng, rng.choice(["en", "de"]), rng.choice(lengths)).split()
        for _ in range(rng.randint(1, members)):
            copy = edited(rng, words, rng.randrange(2 + len(words) // 40))
            data.append((len(data), " ".join(copy + passage * (group % 2)), "en", "s", 1))
    rng.shuffle(data)
    return data


@pytest.mark.parametrize("clashing", [False, True])
@pytest.mark.parametrize("data", [awkward(), rows(7, 120)])
def test_classes_equal_brute_force(spark, data, clashing):
    check(spark, data, clashing)


@pytest.mark.parametrize("seed", [1, 2])
def test_edited_copies(spark, seed):
    check(spark, families(seed, 40, 12))


def test_one_family_with_most_rows_in_small_blocks(spark):
    # Crowded values, lists and cells of several blocks.
    data = families(3, 2, 160, lengths=(90,)) + [(10_000 + i, f"only here {i}", "en", "s", 1) for i in range(30)]
    check(spark, data, list_rows=16, cell_shingles=2000, crowd=8)


def test_a_passage_in_many_unlike_texts(spark):
    rng = random.Random(9)
    passage = prose(rng, "de", 70)
    data = [(i, f"{prose(rng, 'en', rng.randint(2, 60))} {passage}", "en", "s", 1) for i in range(250)]
    check(spark, data, crowd=16, list_rows=64)


def test_a_higher_similarity(spark):
    check(spark, families(5, 20, 8), percent=95)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("cell_shingles", [1 << 21, 1500, 300])
@pytest.mark.parametrize("seed", [11, 12])
def test_rows_near_one_that_stays_go(spark, seed, cell_shingles):
    data = families(seed, 6, 25, lengths=(30, 60, 90)) + families(seed, 1, 40, lengths=(60,))
    data = [(i, *d[1:]) for i, d in enumerate(data)] + [(900, None, "en", "s", 0), (901, "", "en", "s", 0)]
    docs = frame(spark, data)
    every = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row"))
    rows_ = {r["doc_id"]: r["row"] for r in every.collect()}
    only = {i for i in rows_ if i % 5}
    chosen = every.where("doc_id % 5 <> 0").select("row")
    gone = {r["row"] for r in near_to_kept(docs, chosen, percent=80, cell_shingles=cell_shingles).collect()}
    sets = {i: plain_set(text) for i, text, *_ in data}
    alike = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    stay = {i for i in only if rows_[i] not in gone}
    assert {900, 901} - stay <= {900} and len(stay) < len(only)
    assert not [(a, b) for a in stay for b in stay if a < b and alike(a, b)]
    assert all(any(alike(i, k) for k in stay) for i in only - stay)


def test_sketches_allow_all_similar_pairs():
    rng = random.Random(6)
    for _ in range(60):
        words = prose(rng, "en", rng.randint(50, 800)).split()
        texts = [" ".join(edited(rng, words, rng.randrange(8))) for _ in range(12)]
        sets = [shingles(t) for t in texts]
        sizes = np.array([len(s) for s in sets])
        whole, part = Sets(sets, sizes), Sets([s[:64] for s in sets], sizes)
        exact, allowed = similar(whole, 85), likely(part, sizes <= 64, 85, 6.5)
        for i in range(12):
            assert not (exact(i, 0, 12) & ~allowed(i, 0, 12)).any()


def test_a_forest_joins_what_is_linked():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3], [1, 2, 3, 4], [1, 2, 3, 4, 5], [9], [9], [7, 8])]
    found = Sets(sets, np.array([len(s) for s in sets]))
    links = forest(found, 75, similar(found, 75))
    assert {frozenset(map(int, x)) for x in links} == {frozenset(x) for x in ((0, 1), (1, 2), (3, 4))}
