"""Ordered scans that never put a whole series into one task.

A series (one symbol, say) may hold a large share of all rows, so no window here is
partitioned by the series key alone. Rows are cut by time into *slots*; what a slot must
know about earlier ones (how many rows, the last row) is computed on one summary row per
slot and handed in as a *seed* row that sorts first in the slot. The summaries of one
series number at most (time span / slot width), whatever the row count.

Once rows carry a dense index, fixed-size *chunks* of the index, with a copied margin of
neighbours, give windows with a proven group size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

DAY_MS = 86_400_000
CHUNK_ROWS = 1024
# Ticks come without a fixed step. A minute keeps a slot in memory reach of one task even when one
# key holds a third of a 100 TB month of them; a slot width never changes a result.
TICK_SLOT_SECONDS = 60


def slot_of_ms(name: str, width_ms: int = DAY_MS) -> Column:
    """Slot of an epoch-millisecond column."""
    return F.expr(f"{name} div {int(width_ms)}L")


def slot_of_ts(name: str, seconds: int = TICK_SLOT_SECONDS) -> Column:
    """Slot of a timestamp column."""
    return F.expr(f"unix_micros({name}) div {int(seconds) * 1_000_000}L")


def sort_key(df: DataFrame, order: Sequence[str]) -> Column:
    """One column that sorts like ``order``, for ``max_by`` and ``min_by``.

    Kept numeric where the types allow: such aggregates run as hash aggregates, while a
    struct key would make Spark sort all rows of a task first.
    """
    if len(order) == 1:
        return F.col(order[0])
    kinds = dict(df.dtypes)
    if len(order) == 2 and kinds[order[0]] == "timestamp" and kinds[order[1]] in ("bigint", "int"):
        high = F.unix_micros(order[0]).cast("decimal(18,0)") * F.expr("20000000000000000000BD")  # beyond any bigint range
        return high + F.col(order[1]).cast("decimal(19,0)")
    return F.struct(*order)


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slot: Column,
    previous: Sequence[str] = (),
    index: str = "row_index",
) -> DataFrame:
    """Add a dense 0-based ``index`` per series and ``prev_<c>`` for each column in ``previous``.

    One shuffle of the rows, on (keys, slot). ``order`` must be a total order inside a
    series, and ``slot`` must not decrease along it.
    """
    keys, order = list(keys), list(order)
    rows = df.withColumn("_slot", slot).withColumns({f"_now_{c}": F.col(c) for c in previous})
    key = sort_key(df, order)
    slots = rows.groupBy(*keys, "_slot").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.max_by(c, key).alias(f"_last_{c}") for c in previous]
    )
    by_series = Window.partitionBy(*keys).orderBy("_slot")
    earlier = by_series.rowsBetween(Window.unboundedPreceding, -1)
    seeds = slots.select(
        *keys,
        "_slot",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        *[F.lag(f"_last_{c}").over(by_series).alias(f"_now_{c}") for c in previous],
    )
    both = rows.withColumns({"_before": F.lit(None).cast("bigint"), "_row": F.lit(True)}).unionByName(
        seeds.withColumn("_row", F.lit(False)), allowMissingColumns=True
    )
    in_slot = Window.partitionBy(*keys, "_slot").orderBy("_row", *order)
    from_seed = in_slot.rowsBetween(Window.unboundedPreceding, 0)
    # All in one projection, so that Spark sorts a slot once.
    out = both.withColumns(
        {
            index: F.max("_before").over(from_seed) + F.row_number().over(in_slot).cast("bigint") - F.lit(2),
            **{f"prev_{c}": F.lag(f"_now_{c}").over(in_slot) for c in previous},
        }
    )
    return out.filter("_row").drop("_slot", "_before", "_row", *[f"_now_{c}" for c in previous])


def with_margin(
    df: DataFrame, size: int, back: int = 0, ahead: int = 0, index: str = "row_index"
) -> DataFrame:
    """Give each row its chunk, and copy rows near a border into the neighbour chunk.

    A chunk group then holds at most ``size + back + ahead`` rows. ``_home`` is true on the
    original copy; keep only those after the window ran.
    """
    if max(back, ahead) > size:
        raise ValueError("the margin must not exceed the chunk size")
    home = F.expr(f"{index} div {size}L")
    place = F.expr(f"{index} % {size}L")
    targets = [home]
    if back:
        targets.append(F.when(place >= size - back, home + 1))
    if ahead:
        targets.append(F.when((place < ahead) & (home > 0), home - 1))
    spread = df.withColumn("_at", home).withColumn("_chunk", F.explode(F.array_compact(F.array(*targets))))
    return spread.withColumn("_home", F.col("_at") == F.col("_chunk")).drop("_at")


def chunk_window(keys: Sequence[str], index: str = "row_index") -> WindowSpec:
    return Window.partitionBy(*keys, "_chunk").orderBy(index)


def own_rows(df: DataFrame) -> DataFrame:
    """Drop the margin copies."""
    return df.filter("_home").drop("_home", "_chunk")


def ema_chunk_rows(spans: Sequence[int], limit: int = 4096) -> int:
    """Largest chunk for which the inverse powers of every decay stay far inside double range."""
    decays = [1 - 2 / (s + 1) for s in spans if s > 1]
    return min([limit] + [max(1, int(230 / -math.log(r))) for r in decays])


def ema(
    df: DataFrame,
    keys: Sequence[str],
    outputs: dict[str, tuple[str, int, bool]],
    index: str = "row_index",
    size: int | None = None,
) -> DataFrame:
    """Exponential moving averages, seeded with the first value, as a chunked prefix scan.

    ``outputs`` maps a new column to (value column, span, full): with ``full`` the first
    span-1 values are null. A null value is an error: no average that skips it would be the recurrence's. The
    recurrence is linear, so a chunk's contribution to later chunks fades by a known factor: each chunk emits its
    end value to the few chunks that can still feel it (a weight of 1e-18 or more, beyond which a double does not
    change), and no series-wide ordering step is needed.
    """
    keys = list(keys)
    if any(span < 1 for _, span, _ in outputs.values()):
        raise ValueError("span must be at least 1")
    size = size or ema_chunk_rows([span for _, span, _ in outputs.values()])
    decay = {name: 1 - 2 / (span + 1) for name, (_, span, _) in outputs.items() if span > 1}
    rows = df.withColumn("_chunk", F.expr(f"{index} div {size}L")).withColumn("_place", F.expr(f"{index} % {size}L"))

    def weighted(name: str) -> Column:
        value, span, _ = outputs[name]
        known = F.coalesce(F.col(value), F.raise_error(F.lit(f"ema: {value} is null")).cast("double"))
        return F.when(F.col(index) == 0, known).otherwise(F.lit(2 / (span + 1)) * known)

    if decay:
        ends = rows.groupBy(*keys, "_chunk").agg(
            *[F.sum(weighted(n) * F.pow(F.lit(r), F.lit(size - 1) - F.col("_place"))).alias(f"_end_{n}") for n, r in decay.items()]
        )
        reach = max(1, *[math.ceil(math.log(1e-18) / (size * math.log(r))) for r in decay.values()])
        seeds = (
            ends.withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(reach))))
            .withColumn("_chunk", F.col("_chunk") + F.col("_step"))
            .groupBy(*keys, "_chunk")
            .agg(
                *[
                    F.sum(F.col(f"_end_{n}") * F.pow(F.lit(r), F.lit(size) * (F.col("_step") - 1))).alias(f"_carry_{n}")
                    for n, r in decay.items()
                ]
            )
            .withColumn("_seed", F.lit(True))
        )
        rows = rows.withColumn("_seed", F.lit(False)).unionByName(seeds, allowMissingColumns=True)
        scan = (
            Window.partitionBy(*keys, "_chunk")
            .orderBy(F.desc("_seed"), index)
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        for n, r in decay.items():
            term = F.when(F.col("_seed"), F.col(f"_carry_{n}") * F.lit(r)).otherwise(
                weighted(n) * F.pow(F.lit(r), -F.col("_place"))
            )
            rows = rows.withColumn(n, F.pow(F.lit(r), F.col("_place")) * F.sum(term).over(scan))
        rows = rows.filter(~F.col("_seed")).drop("_seed", *[f"_carry_{n}" for n in decay])
    for n, (value, span, full) in outputs.items():
        if span == 1:
            rows = rows.withColumn(n, F.col(value))
        if full and span > 1:
            rows = rows.withColumn(n, F.when(F.col(index) >= span - 1, F.col(n)))
    return rows.drop("_chunk", "_place")


def latest_before(
    probes: DataFrame,
    quotes: DataFrame,
    keys: Sequence[str],
    time: str,
    values: Sequence[str],
    slot: Column,
    quote_order: Sequence[str] = (),
) -> DataFrame:
    """As-of join: each probe gets ``values`` and the time of the newest quote at or before it.

    Both sides carry ``keys`` and ``time``; the quote's time comes back as ``quote_<time>``.
    A quote at the very time of a probe counts. Ties between quotes go to the largest
    ``quote_order``. One shuffle on (keys, slot), no per-key group.
    """
    keys = list(keys)
    ties = [f"_tie{i}" for i in range(len(quote_order))]
    found = {f"_q_{v}": F.col(v) for v in values}
    right = (
        quotes.select(*keys, time, *quote_order, *values)
        .withColumns({**found, "_q_at": F.col(time), "_role": F.lit(1)})
        .drop(*values)
        .withColumnsRenamed(dict(zip(quote_order, ties)))
    )
    left = probes.withColumn("_role", F.lit(2))
    rows = left.unionByName(right, allowMissingColumns=True).withColumn("_slot", slot)
    key = F.when(F.col("_role") == 1, sort_key(rows, [time, *ties]))
    carried = ["_q_at", *found]
    slots = rows.groupBy(*keys, "_slot").agg(
        F.count_if(F.col("_role") == 1).alias("_n"), *[F.max_by(c, key).alias(c) for c in carried]
    )
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.when(F.col("_n") > 0, F.struct(*carried))  # a quote may hold nulls and is still a quote
    seeds = slots.select(
        *keys, "_slot", F.last(whole, ignorenulls=True).over(earlier).alias("_seed"), F.lit(0).alias("_role")
    ).filter(F.col("_seed").isNotNull()).select(*keys, "_slot", "_role", "_seed.*")
    scan = (
        Window.partitionBy(*keys, "_slot")
        .orderBy(F.col("_role") > 0, time, "_role", *ties)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    whole = F.when(F.col("_role") < 2, F.struct(*carried))
    out = (
        rows.unionByName(seeds, allowMissingColumns=True)
        .withColumn("_found", F.last(whole, ignorenulls=True).over(scan))
        .filter(F.col("_role") == 2)
        .drop(*carried)
        .withColumn(f"quote_{time}", F.col("_found._q_at"))
    )
    for v in values:
        out = out.withColumn(v, F.col("_found").getField(f"_q_{v}"))
    return out.drop("_role", "_slot", "_found", *ties)
