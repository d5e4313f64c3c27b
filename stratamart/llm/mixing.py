"""Mixing sources to target weights by weighted fair queueing.

Targets share a budget by weight; none exceeds ``max_epochs`` times its source, the excess goes to
the others by weight. The documents of a source are shuffled once for each epoch. A copy's virtual
finish time is its source's words up to and with it, divided by the source's target weight; it starts
when the copy before it finishes. Starts and finishes of the copies of all sources are then sorted by
range in one order, with the running total of the words received, and the order is cut where that total
reaches the budget: within it a copy is taken whole; what the copies being served then have received is
taken of them.

Running sums are made in two steps, over ranges and within them, so neither a hot source nor the
whole order meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratamart.operators.windows import row_numbers
from stratamart.session import stable

WEIGHTS = (3.0, 1.0, 2.0)
RANGE_ROWS = 20_000


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """``(doc_id, source, size)`` with the number of words of ``text`` (0 for null), and the columns ``more``."""
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return stable(docs.select("doc_id", "source", F.coalesce(words, F.lit(0)).alias("size"), *more))


def source_targets(sizes: dict[str | None, int], weights: dict[str | None, float], budget: float, max_epochs: float) -> dict[str | None, float]:
    """Share ``budget`` by weight, none above ``max_epochs`` times its size (water filling)."""
    target, free = {}, {k for k, v in sizes.items() if v > 0}
    target.update({k: 0.0 for k in sizes if k not in free})
    left = budget
    while free:
        total = sum(weights[k] for k in free)
        full = {k for k in free if left * weights[k] / total > max_epochs * sizes[k]}
        if not full:
            target.update({k: left * weights[k] / total for k in free})
            break
        target.update({k: float(max_epochs * sizes[k]) for k in full})
        left -= sum(max_epochs * sizes[k] for k in full)
        free -= full
    return target


def _targets(items: DataFrame, weights: tuple[float, ...], budget: float, max_epochs: float) -> DataFrame:
    """``(source, source_size, target)``; the sources themselves may be many, so the shares are
    found by a few rounds of sums over them: in each round those above their limit are fixed."""
    sums = items.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sums = stable(row_numbers(sums, ["source"], "_place").withColumn(
        "weight", F.element_at(cycle, ((F.col("_place") - 1) % len(weights) + 1).cast("int"))))
    total = sums.agg(F.sum("source_size")).first()[0] or 0
    left, level = budget * total, None
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    fixed_below = -1.0  # sources with cap / weight at most this are full
    while True:
        free = sums.where((cap / F.col("weight")) > fixed_below)
        full = sums.where((cap / F.col("weight")) <= fixed_below).agg(F.sum(cap)).first()[0] or 0.0
        weight = free.agg(F.sum("weight")).first()[0]
        if not weight:
            level = None
            break
        level = (left - full) / weight
        if level <= fixed_below or not free.where((cap / F.col("weight")) < level).limit(1).count():
            break
        fixed_below = level
    target = cap if level is None else F.least(cap, F.lit(level) * F.col("weight"))
    return stable(sums.select("source", "source_size", "docs", target.alias("target")))


def running_sum(rows: DataFrame, group: list, place, order: list, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` in ``group`` up to and with each row, in the order of the
    range number ``place`` and then ``order``; ranges are summed first, then added up."""
    placed = rows.withColumn("_range", place)
    keys = [F.col(c) for c in group]
    per_range = placed.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    before = per_range.withColumn("_before", F.sum("_sum").over(
        Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("_sum")
    match = F.col("l._range") == F.col("r._range")
    for c in group:
        match &= F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_inside", F.sum(value).over(inside))
    joined = summed.alias("l").join(before.alias("r"), match, "left")
    return joined.select("l.*", (F.col("l._inside") + F.coalesce("r._before", F.lit(0))).alias(name)).drop("_range", "_inside")


def cut_time(copies: DataFrame, budget: float, ranges: int) -> float | None:
    """The virtual time when the words received by all sources together reach ``budget``; the last finish
    where they never do, none without a copy.

    ``copies(source, size, target, upto)``. Until a time t a copy has received ``target * (t - start)``,
    less ``target * (t - finish)`` once it has finished. So with the rates of the events until then
    (``target`` from the start on, taken back at the finish) and their words (those before the copy,
    taken back with the copy's), the words received are t times the sum of rates less the sum of words.
    Rates are added up as decimals, so reruns agree.
    """
    rate = F.col("target").cast("decimal(24,6)")
    before = F.col("upto") - F.col("size")
    events = copies.select("source", "upto", F.explode(F.array(
        F.struct((before / F.col("target")).alias("time"), rate.alias("rate"), before.alias("words")),
        F.struct((F.col("upto") / F.col("target")).alias("time"), (-rate).alias("rate"), (-F.col("upto")).alias("words")))).alias("e"))
    # the range-sort: stored, so that a task that runs again sees the same borders
    events = stable(events.select("e.time", "source", "upto", "e.rate", "e.words").repartitionByRange(ranges, "time")
                    .withColumn("_place", F.spark_partition_id()))
    order = ["time", "source", "upto", "rate"]
    total = running_sum(running_sum(events, [], F.col("_place"), order, "rate", "rates"), [], F.col("_place"), order, "words", "past")
    received = F.col("time") * F.col("rates").cast("double") - F.col("past")
    last = total.withColumn("received", received).where(F.col("received") <= budget).agg(
        F.max(F.struct(*order, "received", "rates")).alias("at")).first()["at"]
    if last is None:
        return None
    return last["time"] + ((budget - last["received"]) / float(last["rates"]) if last["rates"] > 0 else 0.0)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, max_epochs: int = 2, seed: int = 11,
        key: str | None = None) -> DataFrame:
    """``docs(doc_id, source, size)`` mixed: one row per document and epoch with ``taken`` > 0, with
    ``epoch``, ``finish`` (virtual time), ``source_size``, ``target``.

    Sources weigh ``weights`` in turn by code point, null last; ``budget`` is a share of all sizes.
    Rows that agree in all columns are put in order among themselves at random. Documents of size 0
    or of a null size are never taken. Two runs give the same mix. A ``key`` column that numbers the
    rows is carried through, and tells those without a ``doc_id`` apart.
    """
    keys = [key] if key else []
    items = docs.select("doc_id", "source", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"), *keys)
    targets = _targets(items, weights, budget, max_epochs)
    real = items.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(max_epochs))))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col(key))) if key else F.col("doc_id")
    shuffled = real.withColumn("_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), "epoch", name)))
    both = shuffled.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.*", "t.source_size", "t.target", "t.docs")
    ranges = F.ceil(F.col("docs") / RANGE_ROWS)
    # sixteen leading bits of the shuffle hash, dealt into as many ranges as the source needs
    place = F.col("epoch") * (1 << 24) + F.floor(F.conv(F.substring("_hash", 1, 5), 16, 10).cast("long") * ranges / (1 << 20))
    cum = running_sum(both, ["source"], place, ["_hash", "doc_id", "size", *keys], "size", "upto")
    timed = stable(cum.withColumn("finish", F.col("upto") / F.col("target")).drop("_hash", "docs"))
    sums = targets.agg(F.sum("source_size").alias("words"), F.sum("docs").alias("docs")).first()
    cut = cut_time(timed, budget * (sums["words"] or 0), max(1, -(-2 * max_epochs * (sums["docs"] or 0) // RANGE_ROWS)))
    served = F.least(F.col("size"), F.greatest(F.lit(0), F.round(F.col("target") * F.lit(cut).cast("double")).cast("long") - (F.col("upto") - F.col("size"))))
    return timed.withColumn("taken", served).where("taken > 0")


def ordered(mixed: DataFrame) -> DataFrame:
    """The mix in serving order, sorted over the whole table by virtual finish time."""
    return mixed.orderBy("finish", F.col("source").isNull(), "source", "epoch", "doc_id")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs(doc_id, source, text)``.

    The size of a text is its number of words, 0 for null. Rows that share a ``doc_id`` are told
    apart by a number of their own, so each keeps its own share.
    """
    rows_of = sized(docs)
    mixed = mix(rows_of, weights, budget, max_epochs)
    taken = mixed.groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("taken"))
    targets = _targets(rows_of, weights, budget, max_epochs)
    rows = rows_of.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    share = rows.alias("d").join(taken.alias("t"), F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.size") == F.col("t.size")), "left") \
        .select("d.*", F.coalesce("t.taken", F.lit(0)).alias("taken"))
    each = share.withColumn("k", F.explode(F.expr("sequence(1, int(rows))"))).withColumn(
        "taken", F.expr("taken div rows") + (F.col("k") <= F.col("taken") % F.col("rows")).cast("long"))
    return each.alias("e").join(targets.alias("g"), F.col("e.source").eqNullSafe(F.col("g.source"))).select(
        "e.doc_id", "e.size", "g.source_size", "g.target", "e.taken")
