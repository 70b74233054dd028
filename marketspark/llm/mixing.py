"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.common import stored

#: Halvings of the exponent's interval; so many are looked at in one job.
HALVINGS, AT_ONCE = 40, 4


def n_tokens(text_col: str = "text") -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _unit(*parts: Column) -> Column:
    """A number below 2**48 from the MD5 of some values: one shuffle of the deck for each seed and round."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 12), 16, 10).cast("long")


def source_counts(docs: DataFrame, source_col: str = "source") -> DataFrame:
    """(source, tokens, docs) of sources that have tokens; null is a source of its own."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).filter("tokens > 0")


def fit_exponent(counts: DataFrame, entropy: float | None = None, repeats: float | None = None) -> float:
    """The exponent a in [0, 1] for weights proportional to share**a, found by bisection.

    ``entropy``: the largest a whose weights have at least this share (0 to 1) of the even mixture's entropy.
    ``repeats``: the smallest a at which no source is repeated more than so many times as often as the
    least repeated one. Each job evaluates the grid of the next few halvings on one row per source.
    """
    if (entropy is None) == (repeats is None):
        raise ValueError("give a target entropy or a repetition limit")
    total = counts.agg(F.sum("tokens").alias("total"), F.count("*").alias("sources")).first()
    if not total.sources:
        return 1.0
    p = F.col("tokens") / F.lit(float(total.total))

    def meets(points: list[float]) -> list[bool]:
        rows = counts.select(F.log(p).alias("l"), F.explode(F.array(*[F.lit(x) for x in points])).alias("a"))
        w = F.exp(F.col("a") * F.col("l"))
        made = rows.groupBy("a").agg(F.sum(w).alias("z"), F.sum(w * F.col("a") * F.col("l")).alias("m"), F.max((F.col("a") - 1) * F.col("l")).alias("hi"), F.min((F.col("a") - 1) * F.col("l")).alias("lo"))
        if entropy is not None:
            ok = F.log("z") - F.col("m") / F.col("z") >= entropy * F.log(F.lit(float(total.sources)))
        else:
            ok = F.exp(F.col("hi") - F.col("lo")) <= repeats
        found = {r.a: r.ok for r in made.select("a", ok.alias("ok")).collect()}
        return [found[x] for x in points]

    # The target is met below a for entropy, above a for repeats; an end that meets it all is the answer.
    want_low = entropy is not None
    if meets([1.0])[0] and want_low:
        return 1.0
    if not want_low and meets([0.0])[0]:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(HALVINGS // AT_ONCE):
        step = (high - low) / 2**AT_ONCE
        points = [low + step * k for k in range(1, 2**AT_ONCE)]
        met = meets(points)
        k = sum(met) if want_low else len(met) - sum(met)
        low, high = low + step * k, low + step * (k + 1)
    return low if want_low else high


def plan(docs: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: int | None = None, seed: int = 1, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row per source: what is taken of it. ``docs`` needs ``n_tokens``.

    weight = share**a / sum; of a ``budget`` in tokens (default: the smallest that takes every source at least
    once) each source gets round(budget x weight): ``epochs`` whole passes and ``rest`` tokens of one more. The
    rest is realised by blocks: a source of n documents has about sqrt(n) blocks; they are permuted, whole
    blocks are taken while the rest lasts, and in the block where it ends documents in a permuted order up to
    and with the one that reaches it. The plan names that block and document (``cut_*``), so that taking is a
    comparison per document. No window runs over a source's documents, only over its blocks or one block.
    """
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), "n_tokens"), "mix-tokens")
    counts = stored(source_counts(rows), "mix-sources")
    a = fit_exponent(counts, entropy, repeats)
    total = counts.agg(F.sum("tokens").alias("t"), F.sum(F.pow("tokens", F.lit(a))).alias("z"), F.max(F.pow("tokens", F.lit(1 - a))).alias("m")).first()
    spend = float(budget) if budget is not None else (total.m or 0.0) * (total.z or 0.0)
    weight = F.pow("tokens", F.lit(a)) / F.lit(total.z or 1.0)
    target = F.round(F.lit(spend) * weight).cast("long")
    sources = counts.select(
        "source", "tokens", "docs", F.lit(a).alias("exponent"), weight.alias("weight"), target.alias("target"),
        F.expr("tokens").alias("_t"), F.ceil(F.sqrt("docs")).cast("long").alias("blocks"),
    ).withColumns({"epochs": F.expr("target div _t").cast("int"), "rest": F.expr("target % _t")}).drop("_t")
    sources = stored(sources, "mix-plan")
    dealt = deal(rows.filter("n_tokens > 0"), sources.select("source", "blocks", "epochs", "rest").filter("rest > 0"), seed)
    order = Window.partitionBy("source").orderBy("block_key", "block")
    sizes = dealt.groupBy("source", "block", "block_key", "rest").agg(F.sum("n_tokens").alias("n"))
    ends = sizes.withColumn("through", F.sum("n").over(order)).filter("through >= rest AND through - n < rest")
    ends = ends.select(F.col("source").alias("s"), F.col("block").alias("cut_block"), F.col("block_key").alias("cut_block_key"), (F.col("rest") - F.col("through") + F.col("n")).alias("left"))
    last = dealt.join(ends, dealt.source.eqNullSafe(ends.s) & (dealt.block == ends.cut_block)).withColumn("through", F.sum("n_tokens").over(Window.partitionBy("s").orderBy("doc_key", "doc_id")))
    last = last.filter("through >= left").groupBy("s", "cut_block", "cut_block_key").agg(F.min(F.struct("doc_key", "doc_id")).alias("cut"))
    last = last.select("s", "cut_block", "cut_block_key", F.col("cut.doc_key").alias("cut_doc_key"), F.col("cut.doc_id").alias("cut_doc_id"))
    return stored(sources.join(last, sources.source.eqNullSafe(last.s), "left").drop("s"), "mix-cuts")


def deal(docs: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """``docs`` of the given sources with their block and the keys that permute blocks and documents."""
    own = sources.withColumnRenamed("source", "own")
    rows = docs.join(own, docs.source.eqNullSafe(own.own)).drop("own")
    rows = rows.withColumn("block", F.pmod(_unit(F.lit(f"b{seed}"), F.col("doc_id")), "blocks"))
    return rows.withColumns({"block_key": _unit(F.lit(f"p{seed}"), F.col("epochs"), F.col("source"), F.col("block")), "doc_key": _unit(F.lit(f"d{seed}"), F.col("epochs"), F.col("doc_id"))})


def mix(docs: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: int | None = None, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with a column ``copy``: each row as often as the mixture takes it (see ``plan``).

    Only the plan, one row per source, is joined to the documents; Spark broadcasts it if it is small. Repeated
    ids fare alike. Texts without words cost nothing and are in every whole epoch, not in the rest; sources
    without any word have no weight and are left out. Null sources are one source. An empty table stays empty.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_tokens(text_col).alias("n_tokens"))
    cuts = plan(sized, entropy, repeats, budget, seed)
    names = [c for c in docs.columns if c != "copy"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_tokens(text_col).alias("n_tokens"))
    rows = deal(rows, cuts.select("source", "blocks", "epochs", "rest", "cut_block", "cut_block_key", "cut_doc_key", "cut_doc_id"), seed)
    before = "block_key < cut_block_key OR block_key = cut_block_key AND block < cut_block"
    within = "block = cut_block AND (doc_key < cut_doc_key OR doc_key = cut_doc_key AND doc_id <= cut_doc_id)"
    more = F.coalesce(F.expr(f"n_tokens > 0 AND rest > 0 AND ({before} OR {within})"), F.lit(False)).cast("int")
    times = F.col("epochs") + more
    taken = rows.filter(times > 0).select("row", F.explode(F.sequence(F.lit(0), times - 1)).alias("copy"))
    return taken.select("row.*", "copy")
