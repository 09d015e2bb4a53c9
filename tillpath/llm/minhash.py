"""Near duplicates by Jaccard similarity of word shingles, from bottom-k sketches of one hash function.

A text is the set of its distinct shingles, hashed to 64 bits each. Its sketch is the ``SKETCH`` smallest
hashes, so a small set is its own sketch. Texts with equal sets are one member from then on. Then

1. **Inverted lists** of retained values. A value is crowded if more than ``CROWD`` sketches retain it.
   A member is listed under its first ``LISTED`` values that aren't crowded, and, only if more of its sketch is crowded
   than `bulk` says, under its first ``LISTED_CROWDED`` crowded ones. So a passage or a line that many texts have
   lists only the texts that consist of little else. Two similar sets share no list with a probability below one in a million:
   at least 0.6 of the values that aren't crowded, or as many of the crowded ones as asked for of all, are common, and a list is missed only if each of
   the first 16, or 10, of the union is not.
2. **Union sketches.** Within a list a walk takes from any member the unvisited ones whose estimate, the share of
   common values in the part of the union that both sketches know, isn't ``SLACK`` standard deviations below the
   similarity asked for. That gives a spanning forest of the likely links, and no list gives more rows than it has members.
3. **Exact sets.** The forests' components are cells; each member's text goes to its cell once, and a walk by exact Jaccard similarity of the whole
   sets gives a spanning forest of the links. Their components are the classes.

Lists and cells beyond a task's size are cut into blocks; every pair of blocks is walked, so nothing is dropped and memory
is bounded by two blocks. Texts of a block are told apart by size first: sets differing by more in size aren't compared.

Null and empty texts, and texts without words, have an empty set and are linked with nothing, not even each other. Repeated rows have equal
sets and share a class. A null id never becomes a class's id unless all its ids are null. An empty table gives no rows. Columns
named like an output column are replaced; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpath.llm.common import kept, marked
from tillpath.llm.components import components

SHINGLE_WORDS = 3
PERCENT = 85
SKETCH = 64
CROWD = 64
LISTED, LISTED_CROWDED = 16, 10
SLACK = 6.5
LIST_ROWS = 2048
"""Members of a list that are walked together."""
CELL_SHINGLES = 1 << 19
"""Shingles of a cell that are walked together, but for a single text with more."""
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words_in: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles, lower-cased in ASCII; of all its words if it has fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    run = min(words_in, len(words))
    if not run:
        return np.zeros(0, np.uint64)
    base = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    mixed = np.full(len(words) - run + 1, run, np.uint64)
    for i in range(run):
        mixed = (mixed ^ base[i : i + len(mixed)]) * MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def sketches(docs: DataFrame, text: str, row_id: str, words_in: int, sketch: int) -> DataFrame:
    """(id, row, size, low, high, sketch) for every row: ``low`` and ``high`` tell sets apart."""
    id_type = docs.schema[row_id].dataType.simpleString()
    names = ["id", "row", "size", "low", "high", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, marks, smallest = [], [], []
            for value in batch.column(2):
                found = shingles(value.as_py(), words_in)
                digest = xxhash.xxh3_128_digest(found.tobytes())
                sizes.append(len(found))
                marks.append(np.frombuffer(digest, np.int64))
                smallest.append(found[:sketch].view(np.int64))
            pair = np.array(marks, np.int64).reshape(-1, 2)
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array(sizes, pa.int64()),
                pa.array(np.ascontiguousarray(pair[:, 0])),
                pa.array(np.ascontiguousarray(pair[:, 1])),
                pa.array(smallest, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    slim = docs.select(F.col(row_id).alias("id"), row_key(F.col(row_id), F.col(text)).alias("row"), F.col(text).alias("t"))
    schema = f"id {id_type}, row long, size long, low long, high long, sketch array<bigint>"
    return slim.mapInArrow(run, schema)


def give_back() -> None:
    """Memory that a task no longer needs goes back to the machine, as its Python worker lives on."""
    pa.default_memory_pool().release_unused()


def row_key(row_id: Column, text: Column) -> Column:
    return F.xxhash64(F.lit("row"), row_id, F.xxhash64(text))


def bulk(percent: int) -> float:
    """The share of crowded values up to which 0.6 of the others must be common for sets to be similar."""
    return 1 - 2.5 * (1 - percent / 100)


class Sets:
    """Sorted sets of hashes, one after the other in the order of their sizes."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray) -> None:
        self.order = np.argsort(sizes, kind="stable")
        self.sizes = sizes[self.order]
        values = [sets[i] for i in self.order]
        self.at = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)
        flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
        self.values, self.numbers = np.unique(flat, return_inverse=True)
        self.marks = np.zeros(len(self.values) + 1, np.int64)

    def of(self, i: int) -> np.ndarray:
        return self.numbers[self.at[i] : self.at[i + 1]]

    def common(self, i: int, low: int, high: int) -> np.ndarray:
        """How many values set ``i`` has in common with each of the sets from ``low`` to ``high``."""
        mine = self.of(i)
        self.marks[mine] = 1
        flat = self.marks[self.numbers[self.at[low] : self.at[high]]]
        self.marks[mine] = 0
        sums = np.concatenate([[0], np.cumsum(flat)])
        starts = self.at[low : high + 1] - self.at[low]
        return np.diff(sums[starts])


def forest(sets: Sets, percent: int, linked: Callable[[int, int, int], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links: ``linked(i, low, high)`` says which of the sets from low to high ``i`` links to."""
    links, sizes = [], sets.sizes
    unseen = np.ones(len(sizes), bool)
    for start in range(len(sizes)):
        if not unseen[start]:
            continue
        unseen[start] = False
        queue = [start]
        while queue:
            at = queue.pop()
            low = int(np.searchsorted(100 * sizes, percent * sizes[at]))
            high = int(np.searchsorted(percent * sizes, 100 * sizes[at], "right"))
            left = np.flatnonzero(unseen[low:high])
            if not len(left):
                continue
            low, high = low + int(left[0]), low + int(left[-1]) + 1
            found = low + np.flatnonzero(linked(at, low, high) & unseen[low:high])
            unseen[found] = False
            links += [(sets.order[at], sets.order[x]) for x in found]
            queue.extend(found.tolist())
    return links


def likely(sets: Sets, whole: np.ndarray, percent: int, slack: float) -> Callable[[int, int, int], np.ndarray]:
    """Whether the union sketch of two sketches allows the similarity. ``whole`` tells which sketches are whole sets."""
    share = percent / 100
    whole = whole[sets.order]
    ends = sets.at[1:]
    # What a sketch knows: everything up to its largest value, or all if it is the whole set.
    known = np.where(whole, len(sets.values), sets.numbers[np.maximum(ends - 1, 0)] if len(sets.numbers) else 0)

    def linked(i: int, low: int, high: int) -> np.ndarray:
        both = np.minimum(known[i], known[low:high])
        mine = np.searchsorted(sets.of(i), both, "right")
        part = sets.numbers[sets.at[low] : sets.at[high]]
        lengths = np.diff(sets.at[low : high + 1])
        within = np.concatenate([[0], np.cumsum(part <= np.repeat(both, lengths))])
        theirs = np.diff(within[sets.at[low : high + 1] - sets.at[low]])
        shared = sets.common(i, low, high)
        union = mine + theirs - shared
        exact = whole[i] & whole[low:high]
        least = share * union - np.where(exact, 0, slack) * np.sqrt(share * (1 - share) * union)
        return (shared > 0) & (shared >= least - 1e-9)

    return linked


def similar(sets: Sets, percent: int) -> Callable[[int, int, int], np.ndarray]:
    """Whether whole sets have the similarity, in whole numbers."""

    def linked(i: int, low: int, high: int) -> np.ndarray:
        shared = sets.common(i, low, high)
        union = sets.sizes[i] + sets.sizes[low:high] - shared
        return (shared > 0) & (100 * shared >= percent * union)

    return linked


def blocks(grouped: DataFrame, sizes: DataFrame, key: list[str]) -> DataFrame:
    """``grouped`` with columns first and second: every pair of a group's blocks, each member in as many as there are blocks.

    ``sizes(*key, blocks)`` says in how many blocks a group is cut; a member's block follows from its ``row``.
    """
    own = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))
    spread = grouped.join(sizes, key).withColumn("own", own).withColumn("other", other)
    pair = {"first": F.least("own", "other"), "second": F.greatest("own", "other")}
    return spread.withColumns(pair).drop("own", "other", "blocks")


def walked(rows: DataFrame, key: list[str], columns: list[str], links: Callable, schema: str = "u long, v long") -> DataFrame:
    """The links of each group of ``rows`` by ``key``: ``links`` takes a list for each of ``columns`` and gives pairs of rows.

    Rows of a group come one after the other, so only one group is held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def found(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            group = pa.Table.from_batches(parts).combine_chunks()
            pairs = links(*(group.column(c) for c in columns)) if group.num_rows > 1 else []
            ends = np.array(pairs, np.int64).reshape(-1, 2)
            arrays = [pa.array(np.ascontiguousarray(ends[:, i])) for i in (0, 1)]
            return pa.RecordBatch.from_arrays(arrays, ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(len(key)))))
            start = 0
            for i in range(batch.num_rows + 1):
                if i < batch.num_rows and keys[i] == (keys[i - 1] if i else last):
                    continue
                if i > start:
                    held.append(batch.slice(start, i - start))
                    start = i
                if i < batch.num_rows and held:
                    yield found(held)
                    held = []
            last = keys[-1]
        if held:
            yield found(held)
        held.clear()
        give_back()

    ordered = rows.select(*key, *columns).repartition(*key).sortWithinPartitions(*key)
    return ordered.mapInArrow(run, schema)


def listed(members: DataFrame, crowd: int, first: int, first_crowded: int, most: float) -> DataFrame:
    """(value, row): the inverted lists of several members. Needs ``members(row, size, sketch)``."""
    entries = members.select("row", F.size("sketch").alias("length"), F.posexplode("sketch").alias("place", "value"))
    counts = entries.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = entries.join(counts, "value")
    # Only values of several members move on; a value's place among those that aren't crowded counts the others too.
    entry = F.struct("place", "value", (F.col("n") > crowd).alias("crowded"))
    by_row = shared.groupBy("row", "length").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    crowded = F.filter("entries", lambda e: e["crowded"])
    places = F.transform(crowded, lambda e: e["place"])
    early = F.filter(
        "entries",
        lambda e: ~e["crowded"] & (e["place"] - F.size(F.filter(places, lambda p: p < e["place"])) < first),
    )
    full = F.size(crowded) > most * F.col("length")
    chosen = F.concat(early, F.when(full, F.slice(crowded, 1, first_crowded)).otherwise(F.slice(crowded, 1, 0)))
    return by_row.select("row", F.explode(F.transform(chosen, lambda e: e["value"])).alias("value"))


def likely_links(members: DataFrame, lists: DataFrame, percent: int, slack: float, sketch: int, list_rows: int) -> DataFrame:
    """(u, v): a spanning forest, list by list, of the pairs whose union sketch allows the similarity."""

    def links(rows: pa.ChunkedArray, sizes: pa.ChunkedArray, kept_values: pa.ChunkedArray) -> list[tuple[int, int]]:
        names, lengths = rows.to_numpy(), sizes.to_numpy()
        flat, at = _flat(kept_values)
        sets = Sets([flat[a:b] for a, b in zip(at[:-1], at[1:])], lengths)
        found = forest(sets, percent, likely(sets, lengths <= sketch, percent, slack))
        return [(names[a], names[b]) for a, b in found]

    sizes = lists.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = sizes.select("value", F.ceil(F.col("n") / list_rows).alias("blocks"))
    spread = blocks(lists, sizes, ["value"])
    rows = spread.join(members.select("row", "size", "sketch"), "row")
    return walked(rows, ["value", "first", "second"], ["row", "size", "sketch"], links)


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists of longs, unsigned, and where each list starts."""
    array = pa.concat_arrays(lists.chunks)
    lengths = pc.list_value_length(array).to_numpy()
    return array.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(lengths)])


def with_blocks(cells: DataFrame, cell_shingles: int) -> DataFrame:
    """(cell, blocks) of the cells of several members."""
    sizes = cells.groupBy("cell").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("m")).where("m > 1")
    return sizes.select("cell", F.least(F.ceil(F.col("n") / cell_shingles), F.col("m")).alias("blocks"))


def with_texts(docs: DataFrame, wanted: DataFrame, text: str, row_id: str) -> DataFrame:
    """``wanted`` with the texts of its rows; texts of other rows need not move."""
    texts = docs.select(row_key(F.col(row_id), F.col(text)).alias("row"), F.col(text).alias("text"))
    return marked(texts, wanted).where("__marked").drop("__marked").join(wanted, "row")


def _whole_sets(rows: pa.ChunkedArray, texts: pa.ChunkedArray, words_in: int) -> tuple[np.ndarray, np.ndarray, Sets]:
    """The rows, each once, with its place and its whole set."""
    names, first = np.unique(rows.to_numpy(), return_index=True)
    found = [shingles(texts[int(i)].as_py(), words_in) for i in first]
    return names, first, Sets(found, np.array([len(x) for x in found], np.int64))


def exact_links(docs: DataFrame, cells: DataFrame, text: str, row_id: str, words_in: int, percent: int, cell_shingles: int) -> DataFrame:
    """(u, v): a spanning forest, cell by cell, of the pairs that have the similarity. Needs ``cells(row, cell, size)``."""

    def links(rows: pa.ChunkedArray, texts: pa.ChunkedArray) -> list[tuple[int, int]]:
        names, _, sets = _whole_sets(rows, texts, words_in)
        return [(names[a], names[b]) for a, b in forest(sets, percent, similar(sets, percent))]

    wanted = blocks(cells.drop("size"), with_blocks(cells, cell_shingles), ["cell"])
    rows = with_texts(docs, wanted, text, row_id)
    return walked(rows, ["cell", "first", "second"], ["row", "text"], links)


STAYS, GOES, WAITS = 0, 1, 2


def verdicts(names: np.ndarray, settled: np.ndarray, whole: bool, sets: Sets, percent: int) -> list[tuple[int, int]]:
    """(row, verdict) of the members of a cell that aren't settled to stay.

    In the order of their rows, a member goes if it is similar to an earlier one that stays. With only a part of the cell at
    hand, a member waits that has an earlier similar one which isn't settled.
    """
    names, settled = names[sets.order], settled[sets.order]
    linked = similar(sets, percent)
    verdict = np.where(settled, STAYS, -1)
    for i in np.argsort(names):
        if verdict[i] == GOES or (whole and verdict[i] == STAYS):
            continue
        low = int(np.searchsorted(100 * sets.sizes, percent * sets.sizes[i]))
        high = int(np.searchsorted(percent * sets.sizes, 100 * sets.sizes[i], "right"))
        near = low + np.flatnonzero(linked(i, low, high))
        near = near[near != i]
        if whole:
            verdict[i] = STAYS
            verdict[near] = GOES
        elif settled[i]:
            verdict[near] = GOES
        elif verdict[i] == -1 and (names[near] < names[i]).any():
            verdict[i] = WAITS
    verdict[verdict == -1] = STAYS
    return [(names[i], verdict[i]) for i in np.flatnonzero(~settled)]


def followers(docs: DataFrame, cells: DataFrame, text: str, row_id: str, words_in: int, percent: int, cell_shingles: int) -> DataFrame:
    """(row) of the members that are similar to an earlier one that stays, in the order of their rows.

    A cell that a task holds is settled at once. Larger ones take rounds: a member stays when no earlier similar one is
    left, and goes when one stays. Rows are hashes, so the rounds grow with the logarithm of a cell.
    """

    def judged(rows: pa.ChunkedArray, texts: pa.ChunkedArray, settled: pa.ChunkedArray, whole: pa.ChunkedArray) -> list[tuple[int, int]]:
        names, first, sets = _whole_sets(rows, texts, words_in)
        return verdicts(names, settled.to_numpy(zero_copy_only=False)[first], whole[0].as_py(), sets, percent)

    counted = kept(with_blocks(cells, cell_shingles))
    left = cells.join(counted.select("cell"), "cell", "left_semi").select("row", "cell", F.lit(False).alias("settled"))
    gone = cells.select("row").limit(0)
    while True:
        wanted = blocks(left, counted, ["cell"]).join(
            counted.select("cell", (F.col("blocks") == 1).alias("whole")), "cell"
        )
        rows = with_texts(docs, wanted, text, row_id)
        said = walked(rows, ["cell", "first", "second"], ["row", "text", "settled", "whole"], judged)
        said = said.groupBy(F.col("u").alias("row")).agg(
            F.bool_or(F.col("v") == GOES).alias("goes"), F.bool_or(F.col("v") == WAITS).alias("waits")
        )
        said = kept(said)
        gone = gone.union(said.where("goes").select("row"))
        waiting = said.where("waits AND NOT goes").select("row")
        if not waiting.limit(1).count():
            return gone
        cells_left = left.join(waiting, "row", "left_semi").select("cell").distinct()
        left = left.join(cells_left, "cell", "left_semi").join(said, "row", "left").where("NOT coalesce(goes, false)")
        left = kept(left.select("row", "cell", (~F.coalesce("waits", F.lit(False))).alias("settled")))


MARK = ["low", "high", "size"]
"""What tells sets apart."""


def similar_cells(
    docs: DataFrame,
    text: str,
    row_id: str,
    only: DataFrame | None = None,
    words_in: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    sketch: int = SKETCH,
    crowd: int = CROWD,
    list_rows: int = LIST_ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, sets and cells.

    Rows are (id, row, size, low, high); sets (size, low, high, row, least) are those of the rows that aren't empty, ``least`` being
    the smallest (absent, id, row) with the set and ``row`` its row; cells (row, cell, size) hold all sets that may be similar to another.
    With ``only(row)`` no other rows are looked at. The chances given above hold from 80 percent on.
    """
    found = sketches(docs, text, row_id, words_in, sketch)
    found = kept(found if only is None else found.join(only, "row", "left_semi"))
    least = F.min(F.struct(F.col("id").isNull().alias("absent"), "id", "row")).alias("least")
    classes = found.where("size > 0").groupBy(*MARK).agg(least, F.min_by("sketch", "row").alias("sketch"))
    classes = classes.select(*MARK, "sketch", "least", F.col("least.row").alias("row"))
    classes = kept(classes)
    members = classes.select("row", "size", "sketch")

    lists = kept(listed(members, crowd, LISTED, LISTED_CROWDED, bulk(percent)))
    likely_pairs = likely_links(members, lists, percent, SLACK, sketch, list_rows)
    cells = components(likely_pairs)
    cells = cells.select(F.col("node").alias("row"), F.col("root").alias("cell"))
    roots = cells.select(F.col("cell").alias("row"), "cell").distinct()
    cells = kept(cells.unionByName(roots).join(members.select("row", "size"), "row"))
    return found.drop("sketch"), classes.drop("sketch"), cells


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    row_id: str = "doc_id",
    words_in: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    cell_shingles: int = CELL_SHINGLES,
    **options: int,
) -> DataFrame:
    """(row_id, n_shingles, component_id, kept) for every row of ``docs``.

    Two rows are linked if their sets have ``percent`` of their union in common; ``component_id`` is the smallest id that
    can be reached over links. Further options are those of `similar_cells`.
    """
    found, classes, cells = similar_cells(docs, text, row_id, words_in=words_in, percent=percent, **options)
    links = exact_links(docs, cells, text, row_id, words_in, percent, cell_shingles)
    reached = components(links).select(F.col("node").alias("row"), "root")
    rooted = classes.join(reached, "row", "left").withColumn("root", F.coalesce("root", "row"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("smallest"))
    named = rooted.join(smallest, "root").select(
        *(F.col(c).alias(f"__{c}") for c in MARK), F.col("smallest.id").alias("component")
    )
    joined = found.join(named, [F.col(c) == F.col(f"__{c}") for c in MARK], "left")
    component = F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("component"))
    return joined.select(
        F.col("id").alias(row_id),
        F.col("size").alias("n_shingles"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )


def near_to_kept(
    docs: DataFrame,
    only: DataFrame,
    text: str = "text",
    row_id: str = "doc_id",
    words_in: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    cell_shingles: int = CELL_SHINGLES,
    **options: int,
) -> DataFrame:
    """(row) of the rows among ``only(row)`` that are similar to one of them that stays; the rest is apart.

    Of rows with equal sets one counts. Rows without words stay.
    """
    found, classes, cells = similar_cells(docs, text, row_id, only, words_in=words_in, percent=percent, **options)
    gone = followers(docs, cells, text, row_id, words_in, percent, cell_shingles).select("row", F.lit(True).alias("goes"))
    judged = classes.join(gone, "row", "left").select(
        *(F.col(c).alias(f"__{c}") for c in MARK), F.col("row").alias("stands"), "goes"
    )
    joined = found.join(judged, [F.col(c) == F.col(f"__{c}") for c in MARK])
    return joined.where("goes OR row <> stands").select("row").distinct()
