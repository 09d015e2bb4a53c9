import random
import re

import pytest

from tests.llm.corpus import SCHEMA, awkward, frame, prose, rows
from tillpath.llm.licences import PHRASES, scan

NOTICES = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "Licensed under the Apache License, Version 2.0.": "apache,apache-2.0",
    "Released under the MIT License.": "mit",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "Redistribution and use in source and binary forms, with or indeed without modification, are permitted": "bsd",
    "He went with the Apache; a licence, Version 2": "",
}


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = []
    for phrase, label in PHRASES.items():
        want = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    places = [i for i, _ in hits]
    ends = (min(places), max(places)) if places else (None, None)
    return len(words), len(hits), *ends, ",".join(sorted({x for _, x in hits}))


def with_notices(seed=4):
    rng = random.Random(seed)
    data = rows(seed, 80)
    for i, notice in enumerate(NOTICES):
        data.append((500 + i, prose(rng, "en", 50) + "\n" + notice + "\n" + prose(rng, "en", 20), "en", "s", 1))
    extra = ["cc by cc by mit license", "MIT LICENSE" * 3, "mit-license\tÄ apache\x00license", "gnu general public license " * 500]
    return data + [(600 + i, t, "en", "s", 1) for i, t in enumerate(extra)]


@pytest.mark.parametrize("data", [with_notices(), [(i, *d[1:]) for i, d in enumerate(awkward())]])
def test_phrases_equal_brute_force(spark, data):
    found = scan(frame(spark, data, clashing=True)).collect()
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels"]
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in found} == {d[0]: plain(d[1]) for d in data}
    for r in found:
        assert 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_notices_are_found_where_they_stand(spark):
    found = {r["doc_id"]: r for r in scan(frame(spark, with_notices())).collect()}
    for i, labels in enumerate(NOTICES.values()):
        assert found[500 + i]["labels"] == labels
        if labels:
            assert 45 <= found[500 + i]["spans"][0]["start"] <= 55 and found[500 + i]["score"] >= 0.6
    assert all(found[i]["labels"] == "" for i in range(80))


def test_empty_table(spark):
    assert scan(spark.createDataFrame([], SCHEMA)).count() == 0
