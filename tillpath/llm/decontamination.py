"""Benchmark passages in documents, by CGK embedding and bit-sampling LSH over item-sized windows.

A document holds an item if some stretch of its words, longer or shorter than the item or not, is at most ``EDITS`` (a share of
the item's words) word edits away from the item. Candidates come from windows of as many words as the item. The CGK walk copies
a string of words onto three times its length: at every step it writes the current word and, by a random bit of (step,
word), stays or moves on. Strings a few edits apart walk in step again soon after each edit, so edit
distance becomes Hamming distance, and a key of ``SAMPLED`` positions of the walk agrees with a
probability that ``AGREEMENT`` bounds from below at the edit limit. Half of the keys sample only the first ``EARLY`` steps, as
walks of long items drift apart. ``repeats`` independent walks raise
that to the target recall. The window that starts where the stretch does walks like it, whatever follows. Windows that share a key with an
item are widened by the edit limit on both sides and searched for the nearest stretch exactly.

Most windows need no walk: a stretch within e edits of an item shares all but 2e of the item's distinct word
pairs with it, and so does the item-sized window at its start, as words beyond the window are inserted ones, which break one pair each.
Word pairs of the items of each length are a bit table of bounded size, as are the items' keys, so
executors get a few megabytes whatever the benchmark's size; a table only prunes, and a full
one would cost time and not results. Windows with a key in the table go to the join. Texts are padded, so those a little shorter than an item are searched too.

Items of fewer than ``MIN_WORDS`` words can't be told from chance if a word differs: they are looked for word for word, by an equi-join
on the hash of all their words. Null and empty texts hold nothing, null and empty items are held nowhere. Copies of an item, ties and repeated rows are reported
alike; of a document's equally near stretches the one that starts first is reported. Texts are read whole.
Empty tables give no rows. Other columns of the documents don't matter.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpath.llm.licences import words_of

EDITS = 0.2
MIN_WORDS = 8
SHORTEST = 3
SAMPLED = 2
AGREEMENT = 0.5
RECALL = 0.99
EARLY = 90
MOST_BITS = 1 << 26
WALKED = 1 << 18
"""Words of the windows walked at a time."""

MIX = np.uint64(0x9E3779B97F4A7C15)
UNMIX = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def allowed(n: int, share: float) -> int:
    return int(math.floor(share * n + 1e-9))


def repeats_for(recall: float, agreement: float = AGREEMENT, sampled: int = SAMPLED) -> int:
    """Independent keys after which a pair at the edit limit shares one with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agreement**sampled)))


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def pairs_of(hashes: np.ndarray, n: int = 0) -> np.ndarray:
    """A hash for each pair of adjacent words, in a space of its own for each ``n``."""
    return mixed(hashes[:-1] * MIX + hashes[1:] + np.uint64(n << 40))


def keys_of(windows: np.ndarray, repeats: int) -> np.ndarray:
    """(windows, repeats) LSH keys of equally long strings of word hashes."""
    count, n = windows.shape
    steps = 3 * n
    draw = np.random.default_rng(n)
    salts = draw.integers(1, 1 << 62, (steps, repeats), np.uint64)
    reach = [steps if i % 2 else min(EARLY, steps) for i in range(repeats)]
    samples = np.sort(np.stack([draw.choice(r, SAMPLED, False) for r in reach]), axis=1)
    padded = np.concatenate([windows, np.zeros((count, 1), np.uint64)], axis=1)
    row = np.arange(count)[:, None]
    at = np.zeros((count, repeats), np.int64)
    keys = np.tile(mixed(np.arange(repeats, dtype=np.uint64) + np.uint64(n << 20)), (count, 1))
    for step in range(int(samples.max()) + 1):
        word = padded[row, at]
        taken = (samples == step).any(axis=1)
        if taken.any():
            keys[:, taken] = mixed(keys[:, taken] ^ (word[:, taken] + np.uint64(step << 33)))
        move = (mixed(word ^ salts[step]) >> np.uint64(40)) & np.uint64(1)
        at = np.minimum(at + move.astype(np.int64), n)
    return keys


def nearest(item: list[str], words: list[str], limit: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the stretch of ``words`` nearest to ``item``, if at most ``limit`` edits away.

    Of equally near ones the first to end, and of those the shortest.
    """
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)

    def scores(pattern: list[str], text: list[str], free: bool) -> Iterator[int]:
        """Edits between the pattern and each prefix of the text; with ``free``, its nearest suffix."""
        where: dict[str, int] = defaultdict(int)
        for i, word in enumerate(pattern):
            where[word] |= 1 << i
        plus, minus, score = full, 0, len(pattern)
        yield score
        for word in text:
            eq = where.get(word, 0)
            x = eq | minus
            d = ((((x & plus) + plus) ^ plus) | x) & full
            h_plus, h_minus = minus | (~(d | plus) & full), plus & d
            score += bool(h_plus & top) - bool(h_minus & top)
            h_plus = (h_plus << 1 | (not free)) & full
            h_minus = h_minus << 1 & full
            plus, minus = h_minus | (~(d | h_plus) & full), h_plus & d
            yield score

    best, end = min((score, at) for at, score in enumerate(scores(item, words, True)))
    if best > limit:
        return None
    back = scores(item[::-1], words[:end][::-1], False)
    return best, end - next(size for size, score in enumerate(back) if score == best), end


def strings_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each ``n`` words in a row."""
    out = np.full(len(hashes) - n + 1, np.uint64(n))
    for i in range(n):
        out = mixed(out * MIX + hashes[i : len(hashes) - n + 1 + i])
    return out


def first_windows(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Of windows with the same words, the first one."""
    powers = np.cumprod(np.r_[np.uint64(1), np.full(len(hashes) - 1, MIX)])
    sums = np.cumsum(np.r_[np.uint64(0), mixed(hashes) * powers])
    back = np.cumprod(np.r_[np.uint64(1), np.full(len(hashes) - 1, UNMIX)])
    content = (sums[starts + n] - sums[starts]) * back[starts]
    return np.sort(starts[np.unique(content, return_index=True)[1]])


def earlier_same(values: np.ndarray) -> np.ndarray:
    """For each value, where it stood last before, or -1."""
    order = np.argsort(values, kind="stable")
    same = values[order[1:]] == values[order[:-1]]
    out = np.full(len(values), -1)
    out[order[1:][same]] = order[:-1][same]
    return out


def bit_table(rows: DataFrame, hashes: str, count: int) -> np.ndarray:
    """A packed table with a bit for each value of the long column ``hashes``.

    It has 128 bits for each of ``count`` values, up to ``MOST_BITS``; merged by or-ing 64-bit words.
    """
    bits = min(MOST_BITS, 1 << max(16, (128 * max(count, 1) - 1).bit_length()))
    slot = F.col(hashes).bitwiseAND(F.lit(bits - 1))
    word, place = F.shiftright(slot, 6), slot.bitwiseAND(F.lit(63)).cast("int")
    placed = rows.select(word.alias("w"), place.alias("p"))
    merged = placed.select("w", F.expr("shiftleft(1L, p)").alias("b"))
    table = np.zeros(bits // 64, np.int64)
    for r in merged.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        table[r["w"]] = r["b"]
    return table.view(np.uint64)


def in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(len(table) * 64 - 1)
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def item_hashes(items: DataFrame, repeats: int) -> DataFrame:
    """(item_id, words, n, keys, pairs, plain) of each item: its words, keys and word pairs.

    One of fewer than ``MIN_WORDS`` words has one key, the hash of all its words, and no pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                n = len(words)
                hashes = hashed(words)
                if n >= MIN_WORDS:
                    many = keys_of(hashes[None, :], repeats)[0], pairs_of(hashes, n), pairs_of(hashes)
                elif n:
                    many = strings_of(hashes, n), hashes[:0], hashes[:0]
                else:
                    continue
                many = [x.view(np.int64).tolist() for x in many]
                rows.append((item, b" ".join(words).decode(errors="replace"), n, *many))
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [batch.schema.types[0], pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 3]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["item_id", "words", "n", "keys", "pairs", "plain"])

    kind = items.schema["item_id"].dataType.simpleString()
    lists = ", ".join(f"{c} array<bigint>" for c in ("keys", "pairs", "plain"))
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, words string, n bigint, {lists}")


def dense_enough(need: dict[int, int]) -> int:
    """How many items' word pairs some stretch of a window has, if the window is worth a look.

    A stretch is as many pairs in a row as the shortest item has. Were every stretch of a window to
    have fewer, the whole window would have too few.
    """
    piece = min(need) - 1
    most = lambda n, t: (t - 1) * ((n - 1) // piece) + min((n - 1) % piece, t - 1)
    return max([t for t in range(1, piece + 1) if all(most(n, t) < need[n] for n in need)], default=1)


def find(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    edits: float = EDITS,
    recall: float = RECALL,
) -> DataFrame:
    """(columns of ``docs`` but the text, item_id, start, n_words, edits) for each item in a document.

    ``items`` has item_id and text. ``start`` and ``n_words`` tell the nearest stretch.
    """
    repeats = repeats_for(recall)
    known = item_hashes(items, repeats)
    sizes = known.groupBy("n").agg(
        F.count(F.lit(1)).alias("items"), F.min(F.size(F.array_distinct("plain"))).alias("distinct")
    ).collect()
    short = sorted(r["n"] for r in sizes if r["n"] < MIN_WORDS)
    lengths = sorted(r["n"] for r in sizes if r["n"] >= MIN_WORDS)
    items_in, pairs_in = sum(r["items"] for r in sizes), sum(r["items"] * r["n"] for r in sizes)
    limits = {r["n"]: allowed(r["n"], edits) if r["n"] >= MIN_WORDS else 0 for r in sizes}
    needed = {r["n"]: max(1, r["distinct"] - 2 * limits[r["n"]]) for r in sizes if r["n"] >= MIN_WORDS}
    padding = np.zeros(2 * max(limits.values(), default=0), np.uint64)
    dense = dense_enough(needed) if lengths else 0
    rest = [f.name for f in docs.schema.fields if f.name != text]
    tables = {
        c: bit_table(known.select(F.explode(c).alias("h")), "h", items_in * repeats if c == "keys" else pairs_in)
        for c in ("plain", "pairs", "keys")
    }

    def verbatim(words: list[bytes]) -> list[tuple[int, int, int]]:
        """(start, length, key) of the strings of words whose hash is a short item's."""
        out = []
        for n in short:
            if n <= len(words):
                keys, at = np.unique(strings_of(hashed(words), n), return_index=True)
                hit = in_table(tables["keys"], keys)
                out += [(int(s), n, int(k)) for s, k in zip(at[hit], keys[hit].view(np.int64))]
        return out

    def likely(words: list[bytes]) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(length, padded hashes, starts) of the windows with enough of the items' word pairs."""
        if not lengths or len(words) < lengths[0] - limits[lengths[0]]:
            return []
        hashes = np.concatenate([hashed(words), padding])
        piece = lengths[0] - 1
        plain = np.zeros(len(hashes), np.int64)
        np.cumsum(in_table(tables["plain"], pairs_of(hashes)), out=plain[1:])
        if (plain[piece:] - plain[:-piece]).max() < dense:
            return []
        out = []
        for n in lengths:
            if n - limits[n] > len(words):
                break
            if (plain[n - 1 :] - plain[: len(plain) - n + 1]).max() < needed[n]:
                continue
            pairs = pairs_of(hashes, n)
            hit = in_table(tables["pairs"], pairs)
            seen = np.cumsum(np.pad(hit.astype(np.int64), (1, 0)))
            starts = np.flatnonzero(seen[n - 1 :] - seen[: len(seen) - n + 1] >= needed[n])
            starts = starts[starts <= len(words) - n + limits[n]]
            if len(starts):
                starts = first_windows(hashes, starts, n + limits[n])
                before = np.where(hit, earlier_same(pairs), len(pairs))
                inside = np.lib.stride_tricks.sliding_window_view(before, n - 1)
                some = max(1, WALKED // n)
                parts = np.split(starts, range(some, len(starts), some))
                fresh = np.concatenate([(inside[s] < s[:, None]).sum(axis=1) for s in parts])
                starts = starts[fresh >= needed[n]]
            if len(starts):
                out.append((n, hashes, starts))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            by_length = defaultdict(list)
            rows, begins, sizes, keys = [], [], [], []
            for i, value in enumerate(texts):
                words = words_of(value.as_py())
                for n, hashes, starts in likely(words):
                    by_length[n].append((i, hashes, starts))
                for start, n, key in verbatim(words):
                    rows.append(i)
                    begins.append(start)
                    sizes.append(n)
                    keys.append([key])
            for n, parts in by_length.items():
                owner = np.concatenate([np.full(len(s), i) for i, _, s in parts])
                start = np.concatenate([s for _, _, s in parts])
                some = max(1, WALKED // n)
                for low in range(0, len(owner), some):
                    part = slice(low, low + some)
                    own = {i: h for i, h, _ in parts}
                    windows = np.stack([own[i][s : s + n] for i, s in zip(owner[part], start[part])])
                    found = keys_of(windows, repeats)
                    hit = in_table(tables["keys"], found)
                    for w in np.flatnonzero(hit.any(axis=1)):
                        rows.append(int(owner[part][w]))
                        begins.append(int(start[part][w]))
                        sizes.append(n)
                        keys.append(found[w][hit[w]].view(np.int64).tolist())
            words = {i: words_of(texts[i].as_py()) for i in set(rows)}
            begins, ends = (
                [max(0, s - limits[n]) for s, n in zip(begins, sizes)],
                [s + n + limits[n] for s, n in zip(begins, sizes)],
            )
            said = [b" ".join(words[i][s:e]).decode(errors="replace") for i, s, e in zip(rows, begins, ends)]
            columns = [batch.column(batch.schema.get_field_index(c)).take(pa.array(rows, pa.int64())) for c in rest]
            columns += [pa.array(begins, pa.int64()), pa.array(said, pa.string())]
            columns.append(pa.array(keys, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, [*rest, "start", "said", "keys"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in rest)
    schema = f"{kinds}start bigint, said string, keys array<bigint>"
    windows = docs.select(*rest, text).mapInArrow(run, schema).withColumn("key", F.explode("keys"))
    listed = known.select("item_id", "words", F.explode("keys").alias("key"))
    pairs = windows.drop("keys").join(listed, "key").drop("key")
    pairs = pairs.dropDuplicates([*rest, "start", "item_id", "said"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, words = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("said", "words"))
            found, spans = [], []
            for i, (near, item) in enumerate(zip(said, words)):
                item = item.split(" ")
                if span := nearest(item, near.split(" "), limits[len(item)]):
                    found.append(i)
                    spans.append((span[0], span[1], span[2] - span[1]))
            batch = batch.take(pa.array(found, pa.int64()))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in (*rest, "item_id")]
            apart, at, size = (pa.array(x, pa.int64()) for x in list(zip(*spans)) or [[]] * 3)
            start = pc.add(batch.column(batch.schema.get_field_index("start")), at)
            yield pa.RecordBatch.from_arrays(
                [*columns, start, size, apart], [*rest, "item_id", "start", "n_words", "edits"]
            )

    kind = items.schema["item_id"].dataType.simpleString()
    near = pairs.select(*rest, "item_id", "start", "said", "words").mapInArrow(
        verify, f"{kinds}item_id {kind}, start bigint, n_words bigint, edits bigint"
    )
    best = F.min(F.struct("edits", "start", "n_words")).alias("__best")
    found = near.groupBy(*rest, "item_id").agg(best)
    return found.select(*rest, "item_id", *(F.col(f"__best.{c}").alias(c) for c in ("start", "n_words", "edits")))


def decontaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", row_id: str = "doc_id", shortest: int = SHORTEST
) -> DataFrame:
    """``docs`` without the documents that hold an item of at least ``shortest`` words.

    An answer of a word or two stands in many texts that never saw the benchmark; ``find`` reports those too.
    """
    marked = docs.select(F.col(row_id).alias("__id"), F.xxhash64(text).alias("__hash"), text)
    telling = items.where(F.regexp_count("text", F.lit(r"\S+")) >= shortest)
    held = find(marked, telling, text).select("__id", "__hash").distinct()
    same = docs[row_id].eqNullSafe(held["__id"]) & (F.xxhash64(docs[text]) == held["__hash"])
    return docs.join(held, same, "left_anti")
