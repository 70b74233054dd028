"""Price alerts: quotes, rules, fallback prices, and the stateful firing rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.operators.joins import join_small
from marketspark.operators.ordered import TICK_SLOT_SECONDS, latest_before, slot_of_ts, sort_key
from marketspark.session import settle

RULE_KEY = ["symbol", "exchange", "threshold", "condition"]
# Pause and least price move between two alerts of a rule.
COOLDOWN_SECONDS = 3600
MIN_MOVE = 100.0
PART_COOLDOWNS = 8


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """Newest price per (exchange, symbol); shrinks to one row per key and task before the shuffle."""
    when = sort_key(quotes, ["ts", "seq"])
    return quotes.groupBy("exchange", "symbol").agg(
        F.max_by("price", when).alias("price"), F.max("ts").alias("ts")
    )


def crosses(price: Column, threshold: Column, condition: Column) -> Column:
    """Strictly above or strictly below; any other condition never holds."""
    hit = F.when(condition == "above", price > threshold).when(condition == "below", price < threshold)
    return F.coalesce(hit, F.lit(False))


def matched_rules(quotes: DataFrame, rules: DataFrame) -> DataFrame:
    """Quotes (one or many per key) with the rules of the same exchange and symbol, and whether each is crossed."""
    joined = join_small(quotes, rules, ["exchange", "symbol"])
    return joined.withColumn("crossed", crosses(F.col("price"), F.col("threshold"), F.col("condition")))


def fallback_prices(rules: DataFrame, quotes: DataFrame, default: Sequence[str] = ("binance", "kraken", "bybit")) -> DataFrame:
    """First price available along each rule's exchanges: its own, then its fallbacks in order.

    One row per different (symbol, exchange, fallbacks) of the rules, with the ``fallback_exchanges`` in force;
    those without any price yield no row. ``quotes`` holds at most one price per (exchange, symbol).
    """
    backups = F.coalesce(F.col("fallback_exchanges"), F.array(*[F.lit(e) for e in default]))
    tries = rules.select("symbol", "exchange", backups.alias("fallback_exchanges")).distinct()
    tries = tries.select(
        "*", F.posexplode(F.array_distinct(F.concat(F.array("exchange"), F.col("fallback_exchanges")))).alias("_pos", "_try")
    )
    prices = quotes.select(F.col("exchange").alias("_try"), "symbol", "price")
    place = F.struct("_pos")
    return (
        tries.join(prices, ["symbol", "_try"])
        .groupBy("symbol", "exchange", "fallback_exchanges")
        .agg(F.min_by("price", place).alias("price"), F.min_by("_try", place).alias("source"))
    )


def fresh_price(probes: DataFrame, quotes: DataFrame, keys: Sequence[str], ttl_seconds: float = 5, slot_seconds: int = TICK_SLOT_SECONDS) -> DataFrame:
    """Price from the newest earlier quote if it is younger than the time to live, else null."""
    found = latest_before(probes, quotes, keys, "ts", ["price"], slot_of_ts("ts", slot_seconds), ["seq"])
    age = (F.unix_micros("ts") - F.unix_micros("quote_ts")) / 1_000_000
    return found.withColumn("price", F.when(age < ttl_seconds, F.col("price")))


def price_at(probes: DataFrame, quotes: DataFrame, keys: Sequence[str], slot_seconds: int = TICK_SLOT_SECONDS) -> DataFrame:
    """Price known at each probe's time, however old."""
    return latest_before(probes, quotes, keys, "ts", ["price"], slot_of_ts("ts", slot_seconds), ["seq"])


# ---- firing --------------------------------------------------------------------------------


def fire(
    at: np.ndarray,
    price: np.ndarray,
    last_at: int | None,
    last_price: float | None,
    cooldown: int,
    min_move: float,
    block: int = 4096,
) -> tuple[list[int], int | None, float | None]:
    """Positions that fire among crossings in time order, and the state afterwards.

    A crossing fires when there is no state yet, or the cooldown has passed and the price
    moved by more than ``min_move`` since the last fire.
    """
    fired: list[int] = []
    i, n = 0, len(at)
    while i < n:
        if last_at is not None:
            i = max(i, int(np.searchsorted(at, last_at + cooldown, side="left")))
            while i < n:
                moved = np.abs(price[i : i + block] - last_price) > min_move
                if moved.any():
                    i += int(moved.argmax())
                    break
                i += block
            if i >= n:
                break
        fired.append(i)
        last_at, last_price = int(at[i]), float(price[i])
        i += 1
    return fired, last_at, last_price


def with_source(rules: DataFrame, quotes: DataFrame, default: Sequence[str] = ("binance", "kraken", "bybit")) -> DataFrame:
    """Rules with the exchange (``source``) whose quotes price them: their own, else the first fallback that has any.

    Rules whose symbol has no quote on any of their exchanges keep their own exchange.
    """
    backups = F.coalesce(F.col("fallback_exchanges"), F.array(*[F.lit(e) for e in default]))
    tries = rules.select("symbol", "exchange", backups.alias("_backups")).distinct()
    tries = tries.select("*", F.posexplode(F.array_distinct(F.concat(F.array("exchange"), F.col("_backups")))).alias("_pos", "_try"))
    quoted = quotes.select(F.col("exchange").alias("_try"), "symbol").distinct()
    found = tries.join(quoted, ["symbol", "_try"]).groupBy("symbol", "exchange", "_backups").agg(F.min_by("_try", "_pos").alias("source"))
    return rules.withColumn("_backups", backups).join(found, ["symbol", "exchange", "_backups"], "left").withColumn("source", F.coalesce("source", "exchange")).drop("_backups")


def crossings(quotes: DataFrame, rules: DataFrame) -> DataFrame:
    """Quotes that cross a rule: the only ones that can fire or change state.

    Rules with a ``source`` (see ``with_source``) are priced by the quotes of that exchange.
    """
    if "source" in rules.columns:
        own = rules.withColumnsRenamed({"exchange": "_exchange", "source": "exchange"})
        matched = matched_rules(quotes, own).drop("exchange").withColumnRenamed("_exchange", "exchange")
    else:
        matched = matched_rules(quotes, rules)
    return (
        matched.filter("crossed")
        .select(*RULE_KEY, "ts", "seq", "price")
        .withColumn("_at", F.unix_micros("ts"))
    )


def _part_width(rows: DataFrame, target: int, cooldown: int) -> int:
    """Width in microseconds of the time parts; 0 where no rule has more than ``target`` rows.

    A part spans several cooldowns, so that most of its outcome does not hang on its entry state.
    """
    facts = rows.groupBy(*RULE_KEY).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("a"), F.max("_at").alias("b"))
    most, low, high = facts.agg(F.max("n"), F.min("a"), F.max("b")).first()
    if not most or most <= target:
        return 0
    return max((high - low + 1) * target // most, PART_COOLDOWNS * cooldown, 1)


def next_fires(rows: DataFrame, state: DataFrame, keys: Sequence[str], cooldown: int, min_move: float) -> DataFrame:
    """The next crossing that fires of each part in ``state``; parts without one yield no row.

    ``state`` has the last fire of each part (``_last_at`` in microseconds, ``_last_seq``, ``_last_price``, null
    before the first) and the entry state it began with. Nothing is sorted: every task keeps the earliest crossing
    that may fire, so a part may be spread over all tasks.
    """
    move = F.abs(F.col("price") - F.col("_last_price"))
    after = (F.col("_at") > F.col("_last_at")) | F.col("_last_seq").isNull() | (F.col("seq") > F.col("_last_seq"))
    moved = (move > min_move) & ~F.isnan(move)  # as in ``fire``: a price that is no number never moves
    ready = F.col("_last_at").isNull() | ((F.col("_at") >= F.col("_last_at") + cooldown) & after & moved)
    found = join_small(rows, state, keys).filter(ready)
    found = found.select("*", F.timestamp_micros("_at").alias("_ts"), F.coalesce("seq", F.lit(-(1 << 63))).alias("_seq"))
    return (
        found.withColumn("_when", sort_key(found, ["_ts", "_seq"]))
        .groupBy(*keys, "_in_at", "_in_price")
        .agg(F.min("_at").alias("at"), F.min_by("seq", "_when").alias("seq"), F.min_by("price", "_when").alias("price"))
    )


def search(rows: DataFrame, parts: DataFrame, keys: Sequence[str], cooldown: int, min_move: float) -> DataFrame:
    """Fires of whole parts, each from its entry state, and one end row a part.

    A round finds the next fire of every part that fired in the round before, so there are as many rounds as
    a part has fires, and one more. A part that is as long as n cooldowns has n + 1 fires at most.
    """
    begin = parts.select(*keys, "_in_at", "_in_price")
    state = begin.select("*", F.col("_in_at").alias("_last_at"), F.lit(None).cast("bigint").alias("_last_seq"), F.col("_in_price").alias("_last_price"))
    fires = None
    while True:
        found = settle(next_fires(rows, state, keys, cooldown, min_move))
        fires = found if fires is None else fires.unionByName(found)
        if found.isEmpty():
            break
        state = found.withColumnsRenamed({"at": "_last_at", "seq": "_last_seq", "price": "_last_price"})
    fires = settle(fires)
    last = fires.groupBy(*keys).agg(F.max_by(F.struct("at", "price"), F.struct("at", "seq")).alias("_last"))
    ends = begin.join(last, list(keys), "left").select(
        *keys, F.lit(True).alias("_end"), "_in_at", "_in_price", F.col("_last.at").alias("at"), F.lit(None).cast("bigint").alias("seq"), F.col("_last.price").alias("price")
    )
    return ends.unionByName(fires.withColumn("_end", F.lit(False)))


def replay(
    quotes: DataFrame,
    rules: DataFrame,
    cooldown_seconds: int = COOLDOWN_SECONDS,
    min_move: float = MIN_MOVE,
    part_seconds: int | None = None,
    part_rows: int = 500_000,
    entry: DataFrame | None = None,
) -> DataFrame:
    """Every alert that would have fired over stored quotes, per rule.

    The rule depends on its own past, so a rule's history is cut into time parts that run in
    parallel, each from a guessed entry state; a part of up to ``part_rows`` rows is read in time
    order in small batches and never held as a whole, a larger one is searched (``next_fires``)
    and never put in order. A part whose guess differs from what the parts before it leave
    behind runs again. Parts settle from the earliest on, so the loop ends with the exact
    sequential result, after few rounds as long as parts are longer than the cooldown.
    ``entry`` (the rule's key, ``at`` in microseconds, ``price``) is the last fire before the quotes, as the
    rounds of a stream hand it on.
    """
    return replay_crossings(crossings(quotes, rules), cooldown_seconds, min_move, part_seconds, part_rows, entry)


def replay_crossings(
    crossed: DataFrame,
    cooldown_seconds: int = COOLDOWN_SECONDS,
    min_move: float = MIN_MOVE,
    part_seconds: int | None = None,
    part_rows: int = 500_000,
    entry: DataFrame | None = None,
) -> DataFrame:
    """``replay`` of quotes that are known to cross their rules, as ``crossings`` gives them."""
    rows = settle(crossed)
    cooldown = cooldown_seconds * 1_000_000
    width = part_seconds * 1_000_000 if part_seconds is not None else _part_width(rows, part_rows, cooldown)
    part = F.expr(f"_at div {width}L") if width else F.lit(0).cast("bigint")
    rows = rows.drop("ts").withColumn("_part", part)
    keys = [*RULE_KEY, "_part"]
    result = (
        "symbol string, exchange string, threshold double, condition string, _part bigint, "
        "_end boolean, _in_at bigint, _in_price double, at bigint, seq bigint, price double"
    )

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Fires of one part, then one end row with the entry state and the last fire."""
        entry = state = seen = last = None
        for batch in batches:
            at, price = batch["_at"].to_numpy(), batch["price"].to_numpy()
            if seen is None:
                known = not pd.isna(batch["_in_at"].iloc[0])
                entry = state = (int(batch["_in_at"].iloc[0]), float(batch["_in_price"].iloc[0])) if known else (None, None)
            if (np.diff(at) < 0).any() or (seen is not None and at[0] < seen):
                raise ValueError("a part must arrive in time order")
            seen = at[-1]
            fired, *state = fire(at, price, *state, cooldown, min_move)
            if fired:
                last = state
                yield _rows(key, False, entry, at[fired], batch["seq"].to_numpy()[fired], price[fired])
        end = last or (None, None)
        yield _rows(key, True, entry, [end[0]], [None], [end[1]])

    def _rows(key: tuple, end: bool, entry: tuple, at, seq, price) -> pd.DataFrame:
        out = pd.DataFrame({"at": pd.array(at, "Int64"), "seq": pd.array(seq, "Int64"), "price": pd.array(price, "Float64")})
        facts = dict(zip(keys, key)) | {"_end": end}
        out = out.assign(**facts, _in_at=pd.array([entry[0]] * len(out), "Int64"), _in_price=pd.array([entry[1]] * len(out), "Float64"))
        return out[[*keys, "_end", "_in_at", "_in_price", "at", "seq", "price"]]

    crowded = None
    if width:
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        crowded = settle(sizes.filter(F.col("_rows") > part_rows).select(*keys))
        if crowded.isEmpty():
            crowded = None
    calm = rows if crowded is None else settle(join_small(rows, crowded, keys, "left_anti"))
    hot = None if crowded is None else settle(join_small(rows, crowded, keys, "left_semi"))

    def evaluate(with_entry: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Fires and end rows of the parts to which ``with_entry`` gives an entry state (it may drop others)."""
        in_order = with_entry(calm).repartition(*keys).sortWithinPartitions(*keys, "_at", "seq")
        out = in_order.groupBy(*keys).applyInPandas(run, result)
        if crowded is None:
            return out
        parts = settle(with_entry(crowded))
        return out if parts.isEmpty() else out.unionByName(search(hot, parts, keys, cooldown, min_move))

    if entry is None:
        nothing = {"_in_at": F.lit(None).cast("bigint"), "_in_price": F.lit(None).cast("double")}
        done = settle(evaluate(lambda df: df.withColumns(nothing)))
    else:
        before = settle(entry.select(*RULE_KEY, F.col("at").alias("_in_at"), F.col("price").alias("_in_price")))
        known = before.select(*RULE_KEY, F.struct(F.col("_in_at").alias("at"), F.col("_in_price").alias("price")).alias("_known"))
        done = settle(evaluate(lambda df: join_small(df, before, RULE_KEY, "left")))
    earlier = Window.partitionBy(*RULE_KEY).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    while width:
        # One end row per part: the right entry state is the last fire of any earlier part.
        left = F.when(F.col("at").isNotNull(), F.struct("at", "price"))
        ends = done.filter("_end").select(*keys, "_in_at", "_in_price", F.last(left, ignorenulls=True).over(earlier).alias("_left"))
        linked = ends.withColumn("_from", F.col("_left")) if entry is None else ends.join(known, RULE_KEY, "left").withColumn("_from", F.coalesce("_left", "_known"))
        same = F.col("_from.at").eqNullSafe(F.col("_in_at")) & F.col("_from.price").eqNullSafe(F.col("_in_price"))
        wrong = settle(linked.filter(~same).select(*keys, F.col("_from.at").alias("_in_at"), F.col("_from.price").alias("_in_price")))
        if wrong.isEmpty():
            break
        again = evaluate(lambda df: join_small(df, wrong, keys))
        done = settle(done.join(wrong.select(*keys), keys, "left_anti").unionByName(again))
    return done.filter(~F.col("_end")).select(*RULE_KEY, F.timestamp_micros("at").alias("ts"), "seq", "price")
