"""Mixing sources to target weights by Pareto order sampling [native]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, aside, fewer_tasks, unit_interval, word_count

#: Rows of a source that one window task ranks, on average.
ROWS_PER_SLICE = 2_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point (null last) take the weights in turn and share the total
    by weight.  A target stops at ``most`` times its source's size and the excess
    is shared again by weight, until none is above: with sources in order of
    most * size / weight, those that stop are a prefix, found by running sums.
    The table has one row per source, so its single-task order is not a hot spot."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", pick.cast("long")).withColumn("cap", F.lit(most) * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = t.withColumns({
        "left": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weights": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    # this source stops if its share of what those before it leave is above its cap
    t = t.withColumn("stops", F.col("cap") * F.col("weights") <= F.col("weight") * F.col("left"))
    t = t.withColumns({
        "left": F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))).over(every), F.lit(0)),
        "weights": F.sum(F.when(~F.col("stops"), F.col("weight"))).over(every),
    })
    share = F.col("weight").cast("double") * F.col("left") / F.col("weights")
    return t.select("source", "source_size", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): size is the number of words, h the md5 of the text."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("h"))


def weight(size: Column) -> Column:
    """What a document's copies are proportional to: the square root of its size, in
    sixteenths, so that sums are exact.  Long documents come more often than short
    ones, as in sampling by size, but less steeply."""
    return F.floor(F.sqrt(size.cast("double")) * 16).cast("long")


def copy_rates(sizes: DataFrame, targets: DataFrame, most: int = 3) -> DataFrame:
    """(source, rate): a document's expected copies are least(most, rate * weight), and
    over a source, copies * size add up to its target.

    ``sizes`` has a row (source, size, n) for each size, however many documents bear it.
    In order of falling weight, those that stop at ``most`` are a prefix, found by
    running sums over the sizes that occur."""
    t = sizes.where("size > 0").withColumn("w", weight(F.col("size"))).join(targets.select(F.col("source").alias("ts"), "target"), F.col("source").eqNullSafe(F.col("ts"))).drop("ts")
    t = t.groupBy("source", "w").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.first("target").alias("target"))
    before = Window.partitionBy("source").orderBy(F.desc("w")).rowsBetween(Window.unboundedPreceding, -1)
    from_here = Window.partitionBy("source").orderBy(F.desc("w")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("target") - F.lit(most) * F.coalesce(F.sum("words").over(before), F.lit(0))
    t = t.withColumn("rate", left / F.sum(F.col("words") * F.col("w")).over(from_here))
    # the first weight that needn't stop has the rate of all that follow
    free = F.col("rate") * F.col("w") < most - 1e-9
    return t.groupBy("source").agg(F.coalesce(F.max_by(F.when(free, F.col("rate")), F.when(free, F.col("w"))), F.lit(float(most))).alias("rate"))


def copies_of(size: Column, rate: Column, most: Column) -> Column:
    """Expected copies: at least one sixteenth of a weight, so size > 0 decides."""
    return F.when(size > 0, F.least(most.cast("double"), rate * weight(size))).otherwise(0.0)


def pareto_rank(u: Column, f: Column) -> Column:
    """Random odds over inclusion odds; null where nothing is drawn."""
    return F.when(f > 0, (u / (1 - u)) / (f / (1 - f)))


def _edge(ranked: DataFrame, per: Column, keys: list[str], bin_name: str) -> DataFrame:
    """For each key, the first bin behind which a source's words pass ``more``, and the
    words before it; a task meets a key's bins only."""
    sums = ranked.groupBy("ps", *keys, per.alias(bin_name)).agg(F.sum("size").alias("words"), F.first("more").alias("more"), F.first("base").alias("base"))
    upto = Window.partitionBy("ps", *keys).orderBy(bin_name)
    sums = sums.withColumn("end", F.col("base") + F.sum("words").over(upto))
    at = sums.where("end > more").groupBy(F.col("ps").alias("es")).agg(F.min(F.struct(bin_name, (F.col("end") - F.col("words")).alias("start"))).alias("e"))
    return at.select("es", F.col(f"e.{bin_name}").alias(f"{bin_name}_edge"), F.col("e.start").alias("start"))


def mix_plan(small: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """One row per source that decides each document's copies: (ps, source_size,
    target, rate, most, cut, fit1, fit2, every).  ``small`` is as from ``measured``.

    A document's expected copies e are least(most, rate * weight), where the weight
    grows with its size (see ``weight``) and the rate makes them add up to the target.
    floor(e) whole copies are certain.  The fraction f = e - floor(e), which differs
    from document to document, is its inclusion probability for one more: documents are
    ranked by U / (1 - U) over f / (1 - f) (Pareto order sampling), U a hash of doc_id
    and text, and taken up to ``cut`` while the source's remaining words last, so the
    sample's size in words is fixed.  ``fit1`` is that one of the others whose size fills
    the rest best, and ``fit2`` the one that fills best what is then open.  Rows equal in doc_id and text stay together.

    A source may hold any share of the rows.  Its ranks are cut into bins and the bin at
    the boundary into bins again, both as many as the square root of ROWS_PER_SLICE-th
    of its rows; only rows of one bin's bin are ranked one by one."""
    sizes = scratch.keep(small.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    per = scratch.keep(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows")), "per")
    targets = scratch.keep(source_targets(per.select("source", "source_size"), weights, most), "targets")
    rates = copy_rates(sizes, targets, most).withColumnRenamed("source", "rs")
    per = targets.join(per.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    per = per.join(rates, F.col("source").eqNullSafe(F.col("rs")), "left").drop("rs")
    per = per.select(F.col("source").alias("ps"), "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), F.lit(most).alias("most"), F.ceil(F.sqrt(F.col("rows") / ROWS_PER_SLICE)).alias("bins"))
    per = scratch.keep(per, "sources")

    e = copies_of(F.col("size"), F.col("rate"), F.col("most"))
    whole = sizes.join(per, F.col("source").eqNullSafe(F.col("ps"))).groupBy("ps").agg(F.sum(F.floor(e) * F.col("size") * F.col("n")).alias("certain"))
    more = whole.select(F.col("ps").alias("ms"), "certain")
    per_more = scratch.keep(per.join(more, F.col("ps").eqNullSafe(F.col("ms"))).withColumn("more", F.col("target") - F.col("certain")).drop("ms", "certain"), "more")
    ranked = small.join(per_more, F.col("source").eqNullSafe(F.col("ps"))).withColumn("f", e - F.floor(e)).where("f > 0")
    ranked = ranked.withColumn("q", pareto_rank(unit_interval(F.col("doc_id"), F.col("h"), F.lit(seed)), F.col("f")))
    ranked = ranked.groupBy("ps", "q", "doc_id", "h", "bins", "more").agg(F.sum("size").alias("size"))
    # q is 1 where U is f, and about there lies the boundary: these places are spread evenly
    place = F.col("q") / (1 + F.col("q")) * F.col("bins")
    ranked = ranked.withColumn("first", F.least(F.floor(place), F.col("bins") - 1)).withColumn("second", F.floor((place - F.col("first")) * F.col("bins")))
    ranked = scratch.keep(ranked.withColumn("base", F.lit(0).cast("long")).drop("bins"), "ranked")
    edge = scratch.keep(_edge(ranked, F.col("first"), [], "first"), "edge1")
    inside = ranked.drop("base").join(edge.withColumnRenamed("start", "base"), F.col("ps").eqNullSafe(F.col("es")) & (F.col("first") == F.col("first_edge"))).drop("es")
    second = _edge(inside, F.col("second"), [], "second")
    edge = edge.drop("start").join(second.withColumnRenamed("es", "es2"), F.col("es").eqNullSafe(F.col("es2"))).drop("es2")
    edge = scratch.keep(edge, "edge")

    at = ranked.drop("base").join(edge, F.col("ps").eqNullSafe(F.col("es"))).drop("es")
    bin_, bound = F.struct("first", "second"), F.struct(F.col("first_edge").alias("first"), F.col("second_edge").alias("second"))
    order = F.struct("q", "doc_id", "h")
    along = Window.partitionBy("ps").orderBy("q", "doc_id", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = at.where(bin_ == bound).withColumn("sum", F.col("start") + F.sum("size").over(along)).where("sum <= more")
    # where that bin begins with a document too large, the cut is the last document before it
    inside = inside.select("ps", order.alias("at"), "sum").unionByName(at.where(bin_ < bound).select("ps", order.alias("at"), F.col("start").alias("sum")))
    cut = scratch.keep(inside.groupBy(F.col("ps").alias("cs")).agg(F.max("at").alias("cut"), F.max("sum").alias("sum")), "cut")
    at = at.join(cut, F.col("ps").eqNullSafe(F.col("cs")), "left").drop("cs")
    later = at.where(F.col("cut").isNull() | (order > F.col("cut")))
    gap = F.col("more") - F.coalesce("sum", "start")
    later = later.withColumn("gap", gap)
    fits = []
    for i in (1, 2):  # what the first leaves open, the second may fill
        fit = later.withColumn("off", F.abs(F.col("gap") - F.col("size"))).where("off < gap").groupBy(F.col("ps").alias(f"f{i}"))
        fits.append(scratch.keep(fit.agg(F.min_by(F.struct("doc_id", "h", "size"), F.struct("off", "q", "doc_id", "h")).alias(f"fit{i}")), f"fit{i}"))
        later = later.join(fits[-1], F.col("ps").eqNullSafe(F.col(f"f{i}"))).where(F.struct("doc_id", "h", "size") != F.col(f"fit{i}")).withColumn("gap", F.col("gap") - F.col(f"fit{i}.size")).drop(f"f{i}", f"fit{i}")
    # where no bin passes the rest, all that can be drawn is
    every = per.join(cut.select("cs", "cut"), F.col("ps").eqNullSafe(F.col("cs")), "left").join(edge.select("es"), F.col("ps").eqNullSafe(F.col("es")), "left")
    open_ = ranked.select("ps").distinct().join(edge.select("es"), F.col("ps").eqNullSafe(F.col("es")), "left_anti").select(F.col("ps").alias("os"), F.lit(True).alias("every"))
    every = every.drop("es").join(open_, F.col("ps").eqNullSafe(F.col("os")), "left")
    for i, fit in enumerate(fits, 1):
        every = every.join(fit, F.col("ps").eqNullSafe(F.col(f"f{i}")), "left")
    fit = [F.struct(f"fit{i}.doc_id", f"fit{i}.h").alias(f"fit{i}") for i in (1, 2)]
    return scratch.keep(every.select("ps", "source_size", "target", "rate", "most", "cut", *fit, F.coalesce("every", F.lit(False)).alias("every")), "plan")


def apply_plan(rows: DataFrame, plan: DataFrame, seed: str = "mix") -> DataFrame:
    """``rows`` (doc_id, source, size, h, ...) with source_size, target, copies and taken."""
    out = rows.join(plan, F.col("source").cast("string").eqNullSafe(F.col("ps")))
    e = copies_of(F.col("size"), F.col("rate"), F.col("most"))
    f = e - F.floor(e)
    q = pareto_rank(unit_interval(F.col("doc_id"), F.col("h"), F.lit(seed)), f)
    order = F.struct(q.alias("q"), "doc_id", "h")
    drawn = q.isNotNull() & (F.col("every") | F.col("cut").isNotNull() & (order <= F.col("cut")) | F.struct("doc_id", "h").isin(F.col("fit1"), F.col("fit2")))
    out = out.withColumn("copies", F.floor(e) + F.when(drawn, 1).otherwise(0))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("ps", "rate", "most", "cut", "fit1", "fit2", "every")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken added.

    size is the number of words in the text (null: 0); target as in
    ``source_targets``; copies as in ``mix_plan``; taken = copies * size, whose sum
    over a source comes as near its target as one document's size allows.  A text
    without words has no copies.  A null source is a source, the last one.  Repeated
    rows are treated alike.  The draw hashes doc_id and text, so reruns agree.  All
    columns of ``docs`` pass, but for those that bear one of the new names, which are
    replaced.  An empty table gives an empty result."""
    scratch = Scratch(docs.sparkSession, "mix")
    new = ("size", "source_size", "target", "copies", "taken")
    rest, back = aside(docs, "doc_id", "text", "source", new=new)
    plan = mix_plan(scratch.keep(measured(fewer_tasks(rest)), "small"), scratch, weights, most, seed)
    text = F.col("text").cast("string")
    rows = rest.withColumn("size", word_count(text)).withColumn("h", F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return apply_plan(rows, plan, seed).select(*back, *new)
