"""Shards balanced in bytes, tokens and rows together, by vector bin packing.

Every group of equal texts is a vector (bytes, tokens, rows). Groups below a fixed share of the
corpus are summed into a fixed number of bundles by hash; larger ones are packed on their own, and
those beyond the capacity of a shard are cut into pieces first. At most four times ``bundles``
vectors are packed, whatever the size of the corpus: largest first, each into the shard where the
dot product of the vector with the shard's residual capacity is highest.

Texts never move for the packing. A row's shard follows from its text's hash by two broadcast
look-ups of bounded size; the only shuffle of rows is the one that numbers them within a shard.

Null and empty texts have no bytes and no tokens, and form one group. Repeated rows and ties are
placed and numbered like any others. An empty table gives no rows. Columns of the input
are kept, save those named like an output column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpath.llm.common import CELL_ROWS, WORD, bits_for, leading_bits, numbered

SIZES = ("bytes", "tokens", "rows")
BUNDLES_PER_SHARD = 512
"""A bundle holds about 1/512 of a shard: the grain to which shards can be evened out."""

Vector = tuple[float, float, float]


def pack(items: list[tuple[object, Vector]], shards: int) -> dict[object, int]:
    """Place each vector in the shard where its dot product with the residual capacity is highest.

    All sizes are taken as shares of a shard's capacity, an equal part of the total. The largest
    vectors are placed first; ties go by the item's key and then to the lowest shard.
    """
    capacity = [sum(v[d] for _, v in items) / shards or 1.0 for d in range(len(SIZES))]
    scaled = [(key, tuple(x / c for x, c in zip(v, capacity))) for key, v in items]
    scaled.sort(key=lambda item: (-max(item[1]), str(item[0])))
    residual = [[1.0] * len(SIZES) for _ in range(shards)]
    placed = {}
    for key, vector in scaled:
        fit = [sum(x * r for x, r in zip(vector, left)) for left in residual]
        best = max(range(shards), key=lambda s: (fit[s], -s))
        residual[best] = [r - x for r, x in zip(residual[best], vector)]
        placed[key] = best
    return placed


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with bytes, CRC and words of its texts, and the hash that stands for the text."""
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns(
        {
            "size": (F.octet_length(content) + 1).cast("long"),
            "text_crc32": F.crc32(content.cast("binary")),
            "tokens": F.regexp_count(content, F.lit(WORD)).cast("long"),
            "__key": F.xxhash64(content),
        }
    )


def _lookup(docs: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """A broadcast table of at most a few times ``bundles`` rows."""
    return F.broadcast(docs.sparkSession.createDataFrame(rows, schema))


def shard_documents(
    docs: DataFrame,
    shards: int = 8,
    text: str = "text",
    row_id: str = "doc_id",
    order: Column | None = None,
    bundles_per_shard: int = BUNDLES_PER_SHARD,
) -> DataFrame:
    """``docs`` with size, text_crc32, tokens, shard and slot.

    Equal texts share a shard unless together they exceed its capacity in bytes, tokens or rows;
    then they are spread evenly by ``row_id`` over as few pieces as fit. Slots follow ``order``, a
    column of whole numbers, or else a hash of ``row_id``; they run from 0 in each shard.
    """
    bundles = shards * bundles_per_shard
    rows = measured(docs, text)
    groups = rows.groupBy("__key").agg(
        F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")
    )
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()
    total = [x or 0 for x in total]
    share = [x / bundles for x in total]
    large = F.greatest(*(F.col(d) > limit for d, limit in zip(SIZES, share)))
    bundle = F.pmod(F.col("__key"), F.lit(bundles)).cast("int")
    light = [F.sum(F.when(~large, F.col(d))).alias(f"{d}_light") for d in SIZES]
    big = F.collect_list(F.when(large, F.struct("__key", *SIZES))).alias("large")
    summary = groups.groupBy(bundle.alias("bundle")).agg(*light, big).collect()

    items: list[tuple[object, Vector]] = []
    cuts: dict[int, int] = {}
    for row in summary:
        if row["rows_light"]:
            items.append((("bundle", row["bundle"]), tuple(float(row[f"{d}_light"]) for d in SIZES)))
        for group in row["large"]:
            pieces = max(1, *(-(-group[d] * shards // t) if t else 1 for d, t in zip(SIZES, total)))
            cuts[group["__key"]] = pieces
            piece = tuple(group[d] / pieces for d in SIZES)
            items += [((group["__key"], n), piece) for n in range(pieces)]
    placed = pack(items, shards)
    of_bundle = [(row["bundle"], placed.get(("bundle", row["bundle"]), 0)) for row in summary]
    of_group = [(key, [placed[key, n] for n in range(pieces)]) for key, pieces in cuts.items()]

    rows = rows.withColumn("__bundle", bundle)
    rows = rows.join(_lookup(docs, of_bundle, "__bundle int, __light int"), "__bundle", "left")
    rows = rows.join(_lookup(docs, of_group, "__key long, __pieces array<int>"), "__key", "left")
    hashed = F.xxhash64(F.col(row_id).cast("string"))
    piece = F.pmod(hashed, F.size("__pieces")).cast("int")
    own = F.when(F.col("__pieces").isNotNull(), F.get("__pieces", piece))
    rows = rows.withColumn("shard", F.coalesce(own, F.col("__light")).cast("int"))

    if order is None:
        rows = rows.withColumn("__order", hashed)
        rows = rows.withColumn("__cell", leading_bits(F.col("__order"), bits_for(total[2] // shards)))
        by = [F.col("__order").bitwiseXOR(F.lit(-(2**63))), F.col(row_id).asc(), F.col("__key").asc()]
    else:
        width = shards * CELL_ROWS
        rows = rows.withColumn("__order", order)
        rows = rows.withColumn("__cell", F.floor(F.col("__order") / width))
        by = [F.col("__order").asc(), F.col(row_id).asc(), F.col("__key").asc()]
    rows = numbered(rows, ["shard"], "__cell", by, "slot")
    return rows.drop("__key", "__bundle", "__light", "__pieces", "__order", "__cell")
