import re
from collections import Counter

import pytest

from tests.llm.corpus import SCHEMA, awkward, frame, prose, rows
from tillpath.llm.quality import fit, judge, rules, vote_columns, with_signals

TEXTS = [
    None,
    "",
    "a b c d e a b c d e",
    " a\tb\nc d e f  a b c d e f\n",
    "x x x x x x",
    "one # line\n\none # line\n \n one # line\none # line",
    "é ü $$$ <|> & ***",
    "a\x85b a\xa0b",
]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered),
    )


@pytest.mark.parametrize("data", [[(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)], awkward(), rows(8, 60)])
def test_signals(spark, data):
    data = [(i, *d[1:]) for i, d in enumerate(data)]
    found = with_signals(frame(spark, data, clashing=True)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in found} == {d[0]: plain(d[1]) for d in data}


def test_junk_goes_and_prose_stays(spark):
    import random

    rng = random.Random(9)
    good = [prose(rng, "en", 120) + "\n" + prose(rng, "en", 40) for _ in range(200)]
    junk = ["\n".join(" | ".join(f"{w}###" for w in g.split()) for g in [x]) for x in good[:20]]
    data = [(i, t, "en", "s", 1) for i, t in enumerate([*good, *junk, "too short", good[0] * 3])]
    found = {r["doc_id"]: r for r in judge(frame(spark, data)).collect()}
    assert all(found[i]["kept"] for i in range(200))
    assert not any(found[i]["kept"] for i in range(200, len(data)))
    assert found[220]["base_failed"] and found[221]["base_failed"] and not found[205]["base_failed"]


def test_votes_abstain_and_rates_are_ordered(spark):
    names = list(rules())
    votes = with_signals(frame(spark, rows(10, 200))).withColumns(vote_columns(names))
    rates, prior = fit(votes, names)
    assert 0 < prior < 1
    for good, bad in rates.values():
        assert abs(sum(good) - 1) < 1e-9 and abs(sum(bad) - 1) < 1e-9
        assert good[0] < bad[0]


def test_no_column_is_lost_and_empty(spark):
    found = judge(frame(spark, awkward(), clashing=True))
    assert "label" in found.columns and found.count() == len(awkward())
    assert judge(spark.createDataFrame([], SCHEMA)).count() == 0
