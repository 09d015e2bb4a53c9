"""Spelling variants of a vocabulary, found on a bit-sliced position index.

The index of a cell of the vocabulary holds, for each place and letter, the set of its words with that letter at
that place, as the bits of one number. A word is looked up against all words of the cell at once: going over its
letters, four sets are kept up to date by and, or and shifted places,

* ``same``: words that agree so far,
* ``changed``: words with one letter replaced so far,
* ``longer``: words with one letter more, so their places are one ahead,
* ``shorter``: words with one letter less, so their places are one behind,

and at the end the words of fitting length in the last three are exactly one edit away. A word's bit stands in the order of frequency, so the
lowest bit is the most frequent near word and the bit count the number of near words; pairs are never listed.

A cell holds the words that agree outside one half: two words one edit apart agree either before or after
the middle of the shorter one, so no pair is lost. The edit's place is taken to be the first place at which the two
differ, so each pair is found in one cell and counts can be added up. A cell of more than ``CELL`` words is cut by single places
instead of halves; such cells have at most 90 + 90 * 90 words, as there are 90 letters.

Null and empty texts have no words; repeated rows count each; a null id is hashed as an empty one. An empty table
gives no rows. Words may be of any length. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpath.llm.common import kept

RUN = re.compile("[a-zÀ-ÿ]+")
SHORTEST = 5
RAREST = 3
TIMES = 2
"""A word's form is at least so many times as frequent."""
CELL = 16384
HELD = 1 << 18
"""Distinct words that a task counts before it passes them on."""
CELLS = "length int, start int, stop int, rest string, word string, n long"
NEAR = "word string, n_near long, n long, form string"


def slipped(run: str, head: int, one_of: int | None) -> str:
    """``run`` without one letter where its hash, begun in ``head``, is divisible by ``one_of``."""
    if one_of:
        hashed = zlib.crc32(run.encode(), head)
        if hashed % one_of == 0:
            at = hashed % len(run)
            return run[:at] + run[at + 1 :]
    return run


def vocabulary(
    docs: DataFrame,
    text: str = "text",
    row_id: str = "doc_id",
    shortest: int = SHORTEST,
    rarest: int = RAREST,
    slips: int | None = None,
) -> DataFrame:
    """(word, n): the runs of letters of the texts with ASCII letters in lower case, and how often each occurs.

    With ``slips`` one in so many (document, run) loses a letter, as chosen by a hash of the two.
    """

    def flushed(counts: Counter) -> pa.RecordBatch:
        columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1)):
                content = value.as_py()
                if not content:
                    continue
                # Bytes are lowered in ASCII only.
                runs = Counter(RUN.findall(content.encode().lower().decode()))
                head = zlib.crc32(f"{key.as_py() or ''}:".encode())
                for found, times in runs.items():
                    word = slipped(found, head, slips)
                    if len(word) >= shortest:
                        counts[word] += times
                if len(counts) >= HELD:
                    yield flushed(counts)
                    counts.clear()
        if counts:
            yield flushed(counts)

    slim = docs.select(F.col(row_id).cast("string").alias("id"), F.col(text).alias("text"))
    counts = slim.mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rarest)


def halves(length: int) -> list[tuple[int, int]]:
    return [(0, length // 2), (length // 2, length)]


def rest_of(word: str, length: int, start: int, stop: int) -> str:
    """What is outside a cell's places, which are counted in the shorter words."""
    return f"{word[:start]}|{word[stop + len(word) - length :]}"


def cells(words: DataFrame) -> DataFrame:
    """The halves' cells of every word: as the shorter one of two words, or as the longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for length in (len(word) - 1, len(word)):
                    out += [(length, a, b, rest_of(word, length, a, b), word, n) for a, b in halves(length)]
            yield _batch(out)

    return words.select("word", "n").mapInArrow(run, CELLS)


def places(crowded: DataFrame) -> DataFrame:
    """The members of crowded cells in cells of a single place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5)))
            for length, start, stop, word, n in rows:
                yield _batch(
                    [(length, p, p + 1, rest_of(word, length, p, p + 1), word, n) for p in range(start, stop)]
                )

    return crowded.mapInArrow(run, CELLS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64()]
    columns = zip(*rows) if rows else [[]] * len(types)
    names = ["length", "start", "stop", "rest", "word", "n"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


class PositionIndex:
    """Bitsets over the words of a cell, which differ between ``start`` and ``stop`` only."""

    def __init__(self, words: list[str], length: int, start: int, stop: int) -> None:
        self.length, self.start, self.stop = length, start, stop
        self.all = (1 << len(words)) - 1
        self.at: dict[tuple[int, str], int] = {}
        self.of_length = {length: 0, length + 1: 0}
        members: dict[tuple[int, str], list[int]] = {}
        for bit, word in enumerate(words):
            self.of_length[len(word)] |= 1 << bit
            for place, letter in enumerate(self.middle(word)):
                members.setdefault((place, letter), []).append(bit)
        for key, bits in members.items():
            octets = bytearray(bits[-1] // 8 + 1)
            for bit in bits:
                octets[bit >> 3] |= 1 << (bit & 7)
            self.at[key] = int.from_bytes(octets, "little")

    def middle(self, word: str) -> str:
        return word[self.start : self.stop + len(word) - self.length]

    def near(self, word: str) -> int:
        """The words one edit from ``word`` that first differ from it in this cell's places, one of the two being of its length."""
        same, changed, longer, shorter = self.all, 0, 0, 0
        letters, at = self.middle(word), self.at.get
        last = self.stop == self.length
        for place, letter in enumerate(letters):
            here = at((place, letter), 0)
            differ = same & ~here
            if place == self.stop - self.start and not last:
                # The two differ beyond this cell's places.
                differ = 0
            changed = changed & here | differ
            longer = (longer | differ) & at((place + 1, letter), 0)
            shorter = shorter & at((place - 1, letter), 0) | differ
            same &= here
        if len(word) != self.length:
            return shorter & self.of_length[self.length]
        if last:
            longer |= same
        return changed & self.of_length[self.length] | longer & self.of_length[self.length + 1]


def near_words(words: DataFrame, cell: int = CELL) -> DataFrame:
    """(word, n_near, form_n, form): how many words are one edit away, and the most frequent of them."""
    key = ["length", "start", "stop", "rest"]
    rows = cells(words)
    crowded = kept(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > cell).select(*key))
    if crowded.limit(1).count():
        finer = places(rows.join(crowded, key, "left_semi"))
        rows = rows.join(crowded, key, "left_anti").unionByName(finer)
    # A cell has at most ``cell`` words, or those of a single place.
    member = F.struct((-F.col("n")).alias("less"), "word")
    whole = rows.groupBy(*key).agg(F.sort_array(F.collect_list(member)).alias("members")).where(F.size("members") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for length, start, stop, members in zip(*(c.to_pylist() for c in batch.columns)):
                listed = [m["word"] for m in members]
                index = PositionIndex(listed, length, start, stop)
                for word in listed:
                    near = index.near(word)
                    if near:
                        first = members[(near & -near).bit_length() - 1]
                        out.append((word, near.bit_count(), -first["less"], first["word"]))
            columns = zip(*out) if out else [[]] * 4
            types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays(arrays, ["word", "n_near", "n", "form"])

    found = whole.select("length", "start", "stop", "members").mapInArrow(run, NEAR)
    best = F.min(F.struct((-F.col("n")).alias("less"), "form")).alias("best")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that is reached from each by following ``forms(word, form)``.

    Every round doubles the steps, and each step doubles the frequency, so rounds are few.
    """
    reached = kept(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = reached.join(ahead, "root", "left")
        further = kept(further.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        if not further.where("moved").limit(1).count():
            return reached
        reached = further.select("word", "root")


def variants(words: DataFrame, times: int = TIMES, cell: int = CELL) -> DataFrame:
    """``words(word, n)`` with form, root, n_near and form_n.

    The form of a word is its most frequent near word, of several the first in code-point order, if it is ``times`` as
    frequent; the root is what is reached by following forms.
    """
    words = kept(words)
    near = near_words(words, cell)
    joined = words.join(near, "word", "left")
    enough = F.col("form_n") >= times * F.col("n")
    joined = kept(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("form")).alias("form"),
            F.when(enough, F.col("form_n")).alias("form_n"),
        )
    )
    found = roots(joined.where(F.col("form").isNotNull()))
    return joined.join(found, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
