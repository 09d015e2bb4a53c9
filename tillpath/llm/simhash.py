"""Near duplicates by SimHash: a grid join over segment bit counts, then exact distances.

A fingerprint has 64 bits, cut into 32 segments of two bits. The bit counts of the segments are a
vector; the Manhattan distance of two such vectors never exceeds the Hamming distance of the
fingerprints. Two fingerprints at most three bits apart are at most one apart in one half of the
vector, so each half is a grid that is joined within Manhattan distance one: a fingerprint goes to
the cell of its half vector, and, where the half holds an odd number of bits, to the cells one step
away too (two vectors one step apart differ in parity, so one of the two always visits the
other). Members of a cell are verified by their exact Hamming distance.

Only distinct fingerprints enter the grid, so copies cost one row, however many there are. A cell
gives a spanning forest of its links instead of all pairs: a walk from any member takes the
unvisited members within the radius, which costs little where many are near each other. A
cell holds 64-bit numbers only: the near copies of one text that fall into the same cell differ in a
few bits, so there are at most some hundred thousand of them even among billions of copies.

Null and empty texts have fingerprint zero and link like any other. Ties and repeated rows
share a fingerprint and a component; a null id never becomes a component's id unless all its ids
are null. An empty table gives no rows. Columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpath.llm.common import kept, marked
from tillpath.llm.components import components
from tillpath.llm.minhash import near_to_kept

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
BLOCK = 1 << 16
"""Shingles hashed at a time, so that memory doesn't follow the length of a text."""

SIMILAR_WORDS = 5
SIMILAR_PERCENT = 80
CROWD = 64
"""Texts that may share a shingle before it is crowded, see `minhash`."""

BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
FIELDS = [np.uint64(1) << np.uint64(2 * i) for i in range(16)]
TWO = np.uint64(2)
LOW = np.uint64(0x5555555555555555)
TABLE_BITS = np.uint64(33)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    seen = [np.bincount(octets[:, place], minlength=256) @ BYTE_BITS for place in range(8)]
    return np.concatenate(seen)


def majority(counts: np.ndarray, of: int) -> int:
    return int(np.packbits(2 * counts > of, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's word shingles, lower-cased in ASCII."""
    words = words_of(text)
    if not words:
        return 0
    last = max(1, len(words) - SHINGLE_WORDS + 1)
    counts = np.zeros(64, np.int64)
    for start in range(0, last, BLOCK):
        stop = min(start + BLOCK, last)
        runs = (words[start + i : stop + i] for i in range(min(SHINGLE_WORDS, len(words))))
        hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*runs)), repeat(SEED))
        counts += bit_counts(np.fromiter(hashes, np.uint64, stop - start))
    return majority(counts, last)


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` other than the text, and ``fp``, the fingerprint as a signed long."""
    rest = [f for f in docs.schema.fields if f.name not in (text, "fp")]
    schema = T.StructType([*rest, T.StructField("fp", T.LongType())])
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            prints = np.fromiter((fingerprint(x.as_py()) for x in texts), np.uint64, len(texts))
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            columns.append(pa.array(prints.view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(*names, text).mapInArrow(run, schema)


def cells_of(prints: np.ndarray, tables: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(cell, fingerprint) for every cell that a fingerprint belongs to or visits.

    Each table has cells of its own.
    """
    counts = prints - ((prints >> np.uint64(1)) & LOW)
    spaces = np.broadcast_to(np.asarray(tables, np.uint64) << TABLE_BITS, prints.shape)
    cells, members = [], []
    for half in (0, 1):
        shift = np.uint64(32 * half)
        vector = (counts >> shift) & np.uint64(0xFFFFFFFF)
        space = spaces | np.uint64(half << 32)
        cells.append(vector | space)
        members.append(prints)
        odd = (np.bitwise_count((prints >> shift) & np.uint64(0xFFFFFFFF)) & 1).astype(bool)
        visiting, home, there = prints[odd], vector[odd], space[odd]
        for i, step in enumerate(FIELDS):
            field = (home >> np.uint64(2 * i)) & np.uint64(3)
            for able, neighbour in ((field < TWO, home + step), (field > 0, home - step)):
                cells.append(neighbour[able] | there[able])
                members.append(visiting[able])
    return np.concatenate(cells), np.concatenate(members)


def forest(members: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints."""
    links = []
    unseen = members
    while unseen.size:
        queue, unseen = [unseen[0]], unseen[1:]
        while queue and unseen.size:
            at = queue.pop()
            near = np.bitwise_count(unseen ^ at) <= radius
            if near.any():
                found = unseen[near]
                links += [(at, x) for x in found]
                queue.extend(found)
                unseen = unseen[~near]
    return links


def _links_of_runs(
    cells: np.ndarray, members: np.ndarray, radius: int
) -> list[tuple[int, int, int]]:
    """(u, v, table) for links within each run of equal cells of sorted arrays."""
    edges = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True])
    sizes = np.diff(edges)
    pairs = edges[:-1][sizes == 2]
    pairs = pairs[np.bitwise_count(members[pairs] ^ members[pairs + 1]) <= radius]
    links = list(zip(members[pairs], members[pairs + 1], cells[pairs] >> TABLE_BITS))
    for start, size in zip(edges[:-1][sizes > 2], sizes[sizes > 2]):
        table = cells[start] >> TABLE_BITS
        links += [(u, v, table) for u, v in forest(members[start : start + size], radius)]
    return links


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v, table) for a spanning set of the links among the distinct values of ``prints.fp``.

    Where ``prints`` has a column ``table``, only fingerprints of the same table are linked.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the grid finds up to {RADIUS} differing bits, not {radius}")
    table = F.col("table").cast("long") if "table" in prints.columns else F.lit(0).cast("long")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables, values = (c.to_numpy().view(np.uint64) for c in batch.columns)
            columns = [pa.array(x.view(np.int64)) for x in cells_of(values, tables)]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        last = None

        def found(parts):
            cells, members = (np.concatenate(x) for x in zip(*parts))
            linked = np.array(_links_of_runs(cells, members, radius), np.uint64).reshape(-1, 3)
            columns = [pa.array(np.ascontiguousarray(linked[:, i]).view(np.int64)) for i in range(3)]
            return pa.RecordBatch.from_arrays(columns, ["u", "v", "table"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cells, members = (c.to_numpy().view(np.uint64) for c in batch.columns)
            # The last cell of a batch may go on in the next one.
            cut = int(np.searchsorted(cells.view(np.int64), cells.view(np.int64)[-1]))
            if cut or (last is not None and cells[0] != last):
                if cut:
                    held.append((cells[:cut], members[:cut]))
                yield found(held)
                held = []
            held.append((cells[cut:], members[cut:]))
            last = cells[-1]
        if held:
            yield found(held)

    distinct = prints.select(table.alias("table"), "fp").distinct()
    cells = distinct.mapInArrow(spread, "cell long, fp long")
    ordered = cells.repartition("cell").sortWithinPartitions("cell")
    return ordered.mapInArrow(verify, "u long, v long, table long")


def classes(prints: DataFrame, least: list[str]) -> DataFrame:
    """(fp, first) for each distinct ``fp``: ``first`` is the least struct of ``least`` in its component."""
    own = prints.groupBy("fp").agg(F.min(F.struct(*least)).alias("own"))
    roots = components(links(prints)).withColumnRenamed("node", "fp")
    rooted = own.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = rooted.groupBy("root").agg(F.min("own").alias("first"))
    return rooted.select("fp", "root").join(first, "root").select("fp", "first")


def near_duplicates(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(row_id, text_hash, fingerprint, component_id, first) for every row of ``docs``.

    ``component_id`` is the smallest id whose fingerprint can be reached over links of at most three
    differing bits; ``first`` the id and text hash of the row that stands for the component.
    """
    slim = docs.select(F.col(row_id).alias("__id"), F.xxhash64(text).alias("text_hash"), text)
    prints = kept(with_fingerprint(slim, text))
    keyed = prints.withColumn("absent", F.col("__id").isNull())
    found = classes(keyed, ["absent", "__id", "text_hash"])
    return keyed.join(found, "fp").select(
        F.col("__id").alias(row_id),
        "text_hash",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.__id").alias("component_id"),
        F.struct(F.col("first.__id").alias("id"), F.col("first.text_hash")).alias("first"),
    )


def row_of(row_id: Column, text_hash: Column) -> Column:
    return F.xxhash64(F.lit("row"), row_id, text_hash)


def deduplicated(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of near duplicates.

    First one row of each component stays, the one with the smallest id, then text hash; where it is
    repeated, one of the equal rows. Of these, rows that have at least 0.8 of their five-word shingles
    in common with a row that stays go too, however the edits are spread. Texts without copies stay where they lie.
    """
    found = near_duplicates(docs, text, row_id)
    stands = F.col("first.id").eqNullSafe(F.col(row_id)) & (F.col("first.text_hash") == F.col("text_hash"))
    rows = found.groupBy(row_of(F.col(row_id), F.col("text_hash")).alias("row"), stands.alias("stands"))
    rows = kept(rows.agg(F.count(F.lit(1)).alias("copies")))
    chosen = rows.where("stands").select("row")
    near = near_to_kept(docs, chosen, text, row_id, words_in=SIMILAR_WORDS, percent=SIMILAR_PERCENT, crowd=CROWD)
    judged = rows.join(near.withColumn("goes", F.lit(True)), "row", "left")
    judged = judged.select("row", "copies", (F.col("stands") & F.col("goes").isNull()).alias("stays"))
    judged = kept(judged.where("NOT stays OR copies > 1").select("row", "stays"))

    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*names).alias("whole"), row_of(F.col(row_id), F.xxhash64(text)).alias("row"))
    keyed = marked(keyed, judged)
    alone = keyed.where("NOT __marked").select("whole.*")
    met = keyed.where("__marked").join(judged, "row", "left")
    others = met.where("stays IS NULL").select("whole.*")
    one = met.where("stays").dropDuplicates(["row"]).select("whole.*")
    return alone.unionByName(others).unionByName(one)
