import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm.corpus import SCHEMA, awkward, frame, rows
from tillpath.llm.spelling import PositionIndex, near_words, variants, vocabulary

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(data, slips=None, shortest=5, rarest=3):
    counts = Counter()
    for doc, text, *_ in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if slips and h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= rarest}


def one_edit(a, b):
    """Whether exactly one insertion, deletion or replacement leads from a to b, by the full table of distances."""
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1] == 1


def brute(words):
    out = {}
    for w, n in words.items():
        near = sorted((-m, v) for v, m in words.items() if one_edit(w, v))
        form = near[0] if near and -near[0][0] >= 2 * n else None
        out[w] = (form and form[1], n, len(near), form and -form[0])
    for w in words:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


def made_up(seed, count, letters="abé", lengths=(4, 5, 6, 7)):
    rng = random.Random(seed)
    found = {"".join(rng.choices(letters, k=rng.choice(lengths))) for _ in range(count)}
    return {w: rng.choice([3, 4, 6, 9, 20, 200, 2000]) for w in found}


def check(spark, words, **options):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants(df, **options).collect()}
    assert got == brute(words)


@pytest.mark.parametrize("words", [made_up(1, 150), made_up(2, 200, "ab", (1, 2, 3, 8)), made_up(3, 120, "xyzÿ", (5, 6))])
def test_forms_equal_brute_force(spark, words):
    check(spark, words)


def test_crowded_cells(spark):
    check(spark, made_up(4, 250, "abc", (4, 5, 6)), cell=8)


def test_each_pair_is_found_once():
    words = sorted(made_up(5, 120, "ab", (5, 6)))
    for length in (5, 6):
        middles = [w for w in words if len(w) in (length, length + 1)]
        found = Counter()
        for start, stop in ((0, length // 2), (length // 2, length)):
            cells = {}
            for w in middles:
                cells.setdefault((w[:start], w[stop + len(w) - length :]), []).append(w)
            for members in cells.values():
                index = PositionIndex(members, length, start, stop)
                for w in members:
                    bits = index.near(w)
                    found.update((w, v) for i, v in enumerate(members) if bits >> i & 1)
        want = {(a, b) for a in middles for b in middles if one_edit(a, b) and min(len(a), len(b)) == length}
        assert set(found) == want and set(found.values()) <= {1}


@pytest.mark.parametrize("slips", [None, 7, 97])
def test_vocabulary(spark, slips):
    data = awkward() + rows(8, 40) + [(5, "ÀÉÎÕÜ straße STRASSE naïve ×÷×÷× Naïve NAÏVE " * 3, "fr", "s", 1)]
    got = {r["word"]: r["n"] for r in vocabulary(frame(spark, data, clashing=True), slips=slips).collect()}
    assert got == plain_counts(data, slips)


def test_words_of_texts(spark):
    data = rows(9, 80)
    words = plain_counts(data, 97)
    got = variants(vocabulary(frame(spark, data), slips=97)).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == brute(words)


def test_long_words(spark):
    long = "x" * 30_000
    words = {long: 9, long + "x": 3, long[:-1] + "y": 4, "y" + long: 30}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    found = {r["word"]: (r["form"], r["n_near"]) for r in variants(df).collect()}
    assert found[long] == ("y" + long, 3)
    assert found[long[:-1] + "y"][0] == long
    assert {w: n for w, (_, n) in found.items()} == {w: sum(one_edit_fast(w, v) for v in words) for w in words}


def one_edit_fast(a, b):
    if a == b:
        return False
    a, b = sorted((a, b), key=len)
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def test_empty_tables(spark):
    assert vocabulary(spark.createDataFrame([], SCHEMA)).collect() == []
    assert variants(spark.createDataFrame([], "word string, n long")).collect() == []
    assert near_words(spark.createDataFrame([("aaaaa", 3)], "word string, n long")).collect() == []
