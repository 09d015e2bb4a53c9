"""Sources mixed to target weights, by Pfair scheduling of their blocks.

Every source, a lane, is a task that needs ``units`` of every ``period`` slots, and a slot holds one
block of ``block_rows`` rows. Block j of a lane is released at slot floor(j * period / units) and
due before slot ceil((j + 1) * period / units). Each slot takes the released block that is due
first. The units add up to the period, so every block is placed between its release and its
deadline, and at any slot each source is less than one block away from its weight.

The schedule repeats after ``period`` slots, so one period is worked out, as one SQL aggregate of
``period`` steps, and joined to the rows by lane and block number. When a source has no blocks
left, its slots stay empty and the others go on in their proportions; no row is left out.

Given weights are taken exactly, as whole numbers or decimals, where their smallest whole ratio adds up to ``LONGEST`` at most:
that sum is the period, and nothing drifts however long the mixture is. Other weights are rounded to units of the period, and what is less than
a block away is the rounded weight. Weights that aren't given are defined in units of the period.

Rows of a source are taken in the order of a hash of their id. A source of any size is numbered in
cells of some hundred rows.

Null sources are a source of their own. Of more than ``lanes`` sources, those with the fewest rows
share a lane, in which they are mixed in proportion to their size. Repeated rows and ties are placed
like others, null ids are hashed as empty text, and an empty table gives no rows. Columns
named like an output column are replaced; all others are kept.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpath.llm.common import bits_for, numbered

BLOCK_ROWS = 16
PERIOD = 1000
LONGEST = 10_000
LANES = 256
EXPONENT = 0.5
"""Without given weights a source weighs (rows ** exponent), so that large ones don't crowd out the rest."""


def units_of(weights: list[float], period: int) -> list[int]:
    """Whole units of the period for each weight, by largest remainder; each gets at least one."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} lanes need a period of at least as many slots, not {period}")
    spare = period - len(weights)
    total = sum(weights)
    exact = [w / total * spare for w in weights]
    units = [math.floor(x) for x in exact]
    rest = sorted(range(len(weights)), key=lambda i: (units[i] - exact[i], i))
    for i in rest[: spare - sum(units)]:
        units[i] += 1
    return [u + 1 for u in units]


def whole_units(weights: list[float], longest: int) -> list[int] | None:
    """The smallest whole numbers in the ratio of the weights as they are written; None if they add up to more than ``longest``."""
    exact = [Fraction(str(w)) for w in weights]
    unit = Fraction(math.gcd(*(x.numerator for x in exact)), math.lcm(*(x.denominator for x in exact)))
    units = [int(x / unit) for x in exact]
    units = [u // math.gcd(*units) for u in units]
    return units if sum(units) <= longest else None


def schedule_sql(units: list[int], period: int) -> str:
    """SQL for the lanes in slot order: of the released blocks, each slot takes the one due first."""
    given = f"array({', '.join(map(str, units))})"
    due = f"CAST(((s.used[i] + 1) * {period} + u - 1) DIV u AS INT)"
    released = f"s.used[i] * {period} DIV u <= t"
    open_lanes = f"transform({given}, (u, i) -> IF({released}, named_struct('due', {due}, 'lane', i), NULL))"
    pick = f"array_min({open_lanes}).lane"
    step = (
        "named_struct('used', transform(s.used, (n, i) -> IF(i = p, n + 1, n)),"
        " 'lanes', concat(s.lanes, array(p)))"
    )
    start = f"named_struct('used', transform({given}, u -> 0), 'lanes', CAST(array() AS ARRAY<INT>))"
    return (
        f"aggregate(sequence(0, {period - 1}), {start},"
        f" (s, t) -> transform(array({pick}), p -> {step})[0], s -> s.lanes)"
    )


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    source: str = "source",
    row_id: str = "doc_id",
    block_rows: int = BLOCK_ROWS,
    period: int = PERIOD,
    lanes: int = LANES,
    exponent: float = EXPONENT,
) -> DataFrame:
    """``docs`` with lane, block, slot, release, deadline and position in the mixture.

    ``weights`` maps sources to target weights; sources without one share the last lane at the mean
    weight of the given ones. Positions run from 0 without gaps.
    """
    spark = docs.sparkSession
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        ranked = sizes.orderBy(F.desc("rows"), F.col("source").asc_nulls_first())
        top = [(r["source"], r["rows"] ** exponent) for r in ranked.limit(lanes).collect()]
    else:
        top = sorted(weights.items(), key=lambda x: (x[0] is not None, x[0] or ""))
        if any(not 0 < w < math.inf for _, w in top):
            raise ValueError("target weights must be positive and finite")
    totals = docs.agg(F.count(F.lit(1)).alias("rows")).first()["rows"]
    listed = spark.createDataFrame(
        [(name, n) for n, (name, _) in enumerate(top)], "__source string, __lane int"
    )
    rest = sizes.join(F.broadcast(listed), F.col("source").eqNullSafe(F.col("__source")), "left_anti")
    shares = [w for _, w in top]
    beyond = rest.agg(F.sum("rows")).first()[0]
    if beyond:
        mean = sum(Fraction(str(w)) for w in shares) / len(shares) if weights else None
        shares.append(beyond**exponent if weights is None else mean)
    if not shares:
        shares = [1.0]
    units = whole_units(shares, LONGEST) if weights else None
    if units is None:
        units = units_of(shares, max(period, 4 * len(shares)))
    period = sum(units)

    # At most ``period`` rows: which lane, and which of its blocks in a period, has which slot.
    slots = spark.range(1).select(F.posexplode(F.expr(schedule_sql(units, period))).alias("__phase", "__on"))
    needs = spark.range(1).select(
        F.posexplode(F.array(*map(F.lit, units))).alias("__on", "__units")
    )
    slots = slots.groupBy("__on").agg(F.sort_array(F.collect_list("__phase")).alias("__phases"))
    slots = F.broadcast(slots.join(needs, "__on"))

    rows = docs.join(F.broadcast(listed), F.col(source).eqNullSafe(F.col("__source")), "left")
    rows = rows.withColumn("lane", F.coalesce("__lane", F.lit(len(top))))
    rows = rows.withColumn("__order", F.md5(F.coalesce(F.col(row_id).cast("string"), F.lit("")).cast("binary")))
    bits = min(32, bits_for(totals))
    leading = F.conv(F.substring("__order", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("__cell", F.shiftright(leading, 32 - bits))
    rows = numbered(rows, ["lane"], "__cell", [F.col("__order").asc(), F.col(row_id).asc()], "__rank")

    rows = rows.join(slots, F.col("lane") == F.col("__on"))
    block = F.floor(F.col("__rank") / block_rows).cast("long")
    rows = rows.withColumn("block", block)
    turn = F.expr("block DIV __units")
    phase = F.get("__phases", F.pmod("block", "__units").cast("int"))
    rows = rows.withColumns(
        {
            "slot": turn * period + phase,
            "release": F.expr(f"block * {period} DIV __units"),
            "deadline": F.expr(f"((block + 1) * {period} + __units - 1) DIV __units"),
            "__within": F.pmod("__rank", F.lit(block_rows)),
        }
    )
    width = max(1, 2048 // block_rows)
    rows = rows.withColumn("__part", F.expr(f"slot DIV {width}")).withColumn("__all", F.lit(0))
    rows = numbered(rows, ["__all"], "__part", [F.col("slot").asc(), F.col("__within").asc()], "position")
    own = ["__source", "__lane", "__order", "__cell", "__rank", "__on", "__phases", "__units"]
    return rows.drop(*own, "__within", "__part", "__all")
