import random

import numpy as np
import pytest

from tests.llm.corpus import CLASHING, SCHEMA, awkward, frame, prose, rows
from tillpath.llm import decontamination as D

ITEMS = "item_id bigint, text string"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def plain_nearest(item, words):
    """Edits between the item and the nearest stretch of the words."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(words):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(rng, words, edits, kinds=(0, 1, 2)):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.choice(kinds)
        if kind == 0:
            out[at] = f"new{rng.randrange(1000)}"
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, f"new{rng.randrange(1000)}")
    return out


def test_nearest_stretch():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randrange(1, 70))]
        b = edited(rng, a, rng.randrange(10)) if rng.random() < 0.7 and len(a) > 12 else [rng.choice("abcd") for _ in range(20)]
        b = [*(rng.choice("abcd") for _ in range(rng.randrange(9))), *b, *(rng.choice("abcd") for _ in range(rng.randrange(9)))]
        edits, start, end = D.nearest(a, b, 200)
        assert edits == plain_nearest(a, b)
        assert plain_distance(a, b[start:end]) == edits
        assert D.nearest(a, b, edits - 1) is None
    assert D.nearest(["a"], ["x", "a", "a"], 0) == (0, 1, 2)


def test_recall_at_the_edit_limit():
    rng = random.Random(2)
    repeats = D.repeats_for(D.RECALL)
    hit = tried = 0
    for n in (15, 30, 60):
        for _ in range(100):
            item = [f"w{rng.randrange(300)}" for _ in range(n)]
            held = edited(rng, item, D.allowed(n, D.EDITS))
            held = (held + [f"t{i}" for i in range(n)])[:n]
            if (plain_distance(item, held)) > D.allowed(n, D.EDITS):
                continue
            keys = [D.keys_of(D.hashed([x.encode() for x in w])[None, :], repeats)[0] for w in (item, held)]
            hit += bool((keys[0] == keys[1]).any())
            tried += 1
    assert tried > 100 and hit / tried >= 0.97


def test_dense_stretches_are_needed():
    rng = np.random.default_rng(3)
    need = {15: 8, 16: 9, 40: 23, 59: 36}
    dense = D.dense_enough(need)
    for n, least in need.items():
        for _ in range(500):
            hits = rng.permutation(np.r_[np.ones(least, int), np.zeros(n - 1 - least, int)])
            assert max(hits[i : i + 14].sum() for i in range(len(hits) - 13)) >= dense


def wanted(data, items):
    """(doc_id, item_id, edits) of every item in a document, by the distance alone."""
    out = set()
    for d in data:
        words = [w.decode() for w in D.words_of(d[1])]
        for i, text in items:
            item = [w.decode() for w in D.words_of(text)]
            limit = D.allowed(len(item), D.EDITS) if len(item) >= D.MIN_WORDS else 0
            if item and (edits := plain_nearest(item, words)) <= limit:
                out.add((d[0], i, edits))
    return out


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_recall_by_kind_of_edit(spark, kind):
    """Substitutions, deletions and insertions at the limit, inside prose and as whole texts."""
    rng = random.Random(10 + kind)
    items = [(i, prose(rng, "en", n)) for i, n in enumerate([10, 15, 22, 30, 45, 60, 120, 200] * 4)]
    data = []
    for i, text in items:
        words = text.split()
        for copy, around in enumerate([(0, 0), (30, 0), (0, 30), (40, 40)]):
            body = edited(rng, words, D.allowed(len(words), D.EDITS), [kind])
            parts = prose(rng, "en", around[0] + 1).split()[1:], body, prose(rng, "en", around[1] + 1).split()[1:]
            data.append((i * 10 + copy, " ".join(sum(parts, [])), "en", "s", 1))
    listed = spark.createDataFrame(items, ITEMS)
    found = {(r["doc_id"], r["item_id"], r["edits"]) for r in D.find(frame(spark, data).select("doc_id", "text"), listed).collect()}
    want = wanted(data, items)
    planted = {w for w in want if w[0] // 10 == w[1]}
    assert len(planted) == len(data)
    assert {f[:2] for f in found} <= {w[:2] for w in want}
    assert len({f[:2] for f in found} & {w[:2] for w in want}) >= 0.95 * len(want)
    assert len(found & want) >= 0.95 * len(want)


def test_short_items_word_for_word(spark):
    items = [(1, "Seven words are one too few here"), (2, "tiny"), (3, "two Words"), (4, ""), (5, None), (6, "two Words")]
    data = [
        (1, "x seven words are one TOO few here. y", "en", "s", 1), (2, "seven words are one too few", "en", "s", 1),
        (3, "tiny", "en", "s", 1), (4, "so tiny, two\nwords two words", "en", "s", 1), (5, "tinytwo words", "en", "s", 1),
        (6, None, "en", "s", 1), (7, "", "en", "s", 1),
    ]
    found = D.find(frame(spark, data).select("doc_id", "text"), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in found} == wanted(data, items)
    at = {(r["doc_id"], r["item_id"]): (r["start"], r["n_words"]) for r in found}
    assert at[1, 1] == (1, 7) and at[4, 3] == (2, 2) and at[3, 2] == (0, 1) and (4, 6) in at


@pytest.mark.parametrize("clashing", [False, True])
def test_against_brute_force(spark, clashing):
    rng = random.Random(5)
    texts = [prose(rng, "en", n) for n in (9, 15, 20, 33, 50)]
    items = [*enumerate(texts), (7, texts[2]), (8, "too short"), (9, None), (10, ""), (None, texts[0])]
    data = rows(6, 40)
    for i in range(40):
        item = rng.choice(texts)
        body = edited(rng, item.split(), rng.choice([0, 0, 1, 2, 4])) if i % 4 else item.upper().split()
        text = "\n".join([prose(rng, "en", 30), " ".join(body), prose(rng, "en", rng.choice([0, 25]))])
        data.append((100 + i, text, "en", "s", 1))
    data.append((200, ("For " * 500) + texts[3] + " For" * 500, "en", "s", 1))
    data.append((201, (texts[1] + " ") * 30, "en", "s", 1))
    listed = spark.createDataFrame(items, ITEMS)
    docs = frame(spark, data, clashing=clashing)
    chosen = docs.select("doc_id", "text", *(c for c in CLASHING[:3] if clashing))
    found = {(r["doc_id"], r["item_id"]) for r in D.find(chosen, listed).collect()}
    want = {w[:2] for w in wanted(data, items)}
    assert found <= want
    assert len(found & want) >= 0.97 * len(want) and len(want) > 40
    exact = {(d[0], i) for d in data for i, t in items if t and len(t.split()) > 8 and t.lower() in (d[1] or "").lower().replace("\n", " ")}
    assert exact <= found


def test_awkward_rows_and_empty_tables(spark):
    data = awkward()
    listed = spark.createDataFrame([(1, data[9][1]), (2, data[-2][1])], ITEMS)
    docs = frame(spark, data, clashing=True)
    kept = D.decontaminated(docs, listed)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1007 not in ids and None in ids and 1003 in ids and ids.count(1001) == 2
    none = spark.createDataFrame([], ITEMS)
    assert D.decontaminated(docs, none).count() == len(data)
    assert D.find(spark.createDataFrame([], SCHEMA).select("doc_id", "text"), listed).count() == 0


def test_an_answer_of_a_word_rejects_nothing(spark):
    listed = spark.createDataFrame([(1, "yes"), (2, "no way"), (3, "three small words")], ITEMS)
    texts = ["yes no way", "has three small words in", "yes three"]
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    assert {r["doc_id"] for r in D.decontaminated(docs, listed).collect()} == {0, 2}
    assert {r["doc_id"] for r in D.decontaminated(docs, listed, shortest=1).collect()} == set()
