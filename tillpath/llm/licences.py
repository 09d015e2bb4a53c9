"""Licence notices by a positional index of rare words.

The corpus decides which words of a licence template are rare: one pass counts the documents in which
each template word occurs. A template is then known by its ``RARE`` words of highest inverse document
frequency, each with its place in the template. In a second pass every occurrence of such a word in a
file implies where the template would start; places on which enough of the template's weight
agrees, give or take ``SLACK`` words, are candidates, and a candidate counts once every mandatory key
phrase of the template is found within it.

Both passes read each text whole, and send no texts over the network. The counts to be merged are one
per template word.

Beside this, the plain phrases of ``PHRASES`` are looked up word by word; their labels always
stay. Null and empty texts have no words, no labels and score 0. Repeated rows are scanned alike; where
two starts tie, the first one counts. An empty table gives no rows. Columns of the input are kept,
save the text and those named like an output column.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The phrases whose labels are given, and notices as they are commonly worded.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = [
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    ("mit", "released under the mit license", ["mit license"]),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software"
        " and associated documentation files",
        ["hereby granted free of charge", "associated documentation files"],
    ),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ["cc0"]),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted",
        ["source and binary forms", "without modification"],
    ),
    (
        "mpl-2.0",
        "subject to the terms of the mozilla public license v 2 0",
        ["mozilla public license"],
    ),
]
RARE = 6
SHARE = 0.6
SLACK = 2

#: ASCII letters in lower case, digits and everything beyond ASCII make words; the rest separates.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def places(words: list[bytes], at: dict[bytes, list[int]], phrase: list[bytes]) -> list[int]:
    """Where the words of a phrase stand consecutively."""
    return [i for i in at.get(phrase[0], ()) if words[i : i + len(phrase)] == phrase]


class Template:
    """A notice with its rare words' places and weights, and its key phrases."""

    def __init__(self, label: str, text: str, keys: list[str], idf: dict[bytes, float]) -> None:
        words = words_of(text)
        first = {}
        for place, word in enumerate(words):
            first.setdefault(word, place)
        rare = sorted(first, key=lambda w: (-idf[w], first[w]))[:RARE]
        self.label, self.length = label, len(words)
        self.rare = [(w, first[w], idf[w]) for w in rare]
        self.weight = sum(idf[w] for w in rare)
        self.keys = [words_of(k) for k in keys]

    def found(self, words: list[bytes], at: dict[bytes, list[int]]) -> tuple[list[tuple[int, float]], float]:
        """(start, share) of each verified notice, and the largest share of any candidate."""
        starts = sorted((i - place, w, idf) for w, place, idf in self.rare for i in at.get(w, ()))
        best, verified, free = 0.0, [], -math.inf
        low = 0
        held: Counter[bytes] = Counter()
        weight = 0.0
        for start, word, idf in starts:
            weight += idf if not held[word] else 0.0
            held[word] += 1
            while starts[low][0] < start - SLACK:
                _, gone, lost = starts[low]
                held[gone] -= 1
                weight -= lost if not held[gone] else 0.0
                low += 1
            share = min(1.0, weight / self.weight)
            best = max(best, share)
            if share >= SHARE and starts[low][0] >= free:
                begin = max(0, starts[low][0] - SLACK)
                part = words[begin : start + self.length + SLACK]
                near = {k[0]: [i for i, w in enumerate(part) if w == k[0]] for k in self.keys}
                if all(places(part, near, k) for k in self.keys):
                    verified.append((max(0, starts[low][0]), share))
                    free = start + self.length
        return verified, best


def document_frequencies(docs: DataFrame, text: str) -> tuple[dict[bytes, int], int]:
    """In how many texts each template word occurs, and the number of texts."""
    vocabulary = {w for _, template, _ in TEMPLATES for w in words_of(template)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            for x in batch.column(0):
                seen.update(vocabulary.intersection(words_of(x.as_py())))
        columns = [pa.array(["", *(w.decode() for w in seen)]), pa.array([rows, *seen.values()], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["word", "n"])

    counted = docs.select(text).mapInArrow(count, "word string, n long")
    sums = {r["word"]: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: sums.get(w.decode(), 0) for w in vocabulary}, sums.get("", 0)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with n_words, n_base, first_word, last_word, base_labels, labels,
    score and spans (label, start, words, share) of the notices found by template."""
    frequency, total = document_frequencies(docs, text)
    idf = {w: math.log((total + 1) / (n + 0.5)) for w, n in frequency.items()}
    templates = [Template(*t, idf) for t in TEMPLATES]
    phrases = [(words_of(p), label) for p, label in PHRASES.items()]
    wanted = frozenset({w for t in templates for w, _, _ in t.rare} | {p[0] for p, _ in phrases})

    def look(value: str | None) -> tuple:
        words = words_of(value)
        if wanted.isdisjoint(words):
            return len(words), 0, None, None, "", "", 0.0, []
        at: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in wanted:
                at.setdefault(w, []).append(i)
        base = [(i, label) for phrase, label in phrases for i in places(words, at, phrase)]
        starts = [i for i, _ in base]
        labels = {label for _, label in base}
        spans, score = [], 0.0
        for t in templates:
            found, best = t.found(words, at)
            score = max(score, best)
            spans += [(t.label, start, t.length, share) for start, share in found]
        both = labels | {s[0] for s in spans}
        ends = (min(starts), max(starts)) if starts else (None, None)
        return len(words), len(base), *ends, ",".join(sorted(labels)), ",".join(sorted(both)), score, sorted(spans, key=lambda s: s[1])

    added = T.StructType.fromDDL(
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
        " score double, spans array<struct<label: string, start: long, words: long, share: double>>"
    )
    names = [f.name for f in docs.schema.fields if f.name not in (text, *added.names)]
    schema = T.StructType([*(docs.schema[n] for n in names), *added.fields])
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("share", pa.float64())])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [look(x.as_py()) for x in batch.column(batch.schema.get_field_index(text))]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            for i, kind in enumerate(kinds):
                values = [r[i] for r in rows]
                if i == 7:
                    values = [[dict(zip(("label", "start", "words", "share"), s)) for s in v] for v in values]
                columns.append(pa.array(values, kind))
            yield pa.RecordBatch.from_arrays(columns, [*names, *added.names])

    return docs.select(*names, text).mapInArrow(run, schema)
