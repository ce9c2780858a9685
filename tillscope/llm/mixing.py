"""Mixing sources to target weights by entropy balancing.

Each source has to give a wanted number of words. Among all document rates up
to ``most`` that do so, the ones nearest to 1 in relative entropy are
exponentially tilted: rate = exp(lambda * size / mean size), cut at ``most``,
with one dual variable per source. Distributed Newton steps on the convex dual
find it; they run on counts per (source, size), never on a source's documents.
Rates become whole copies by systematic rounding along sizes.

Cases: a null or empty text has size 0, its rate is 1 and it takes no words.
A null source is a source of its own, after the others. A source of empty
texts has target 0. Repeated rows are mixed one by one; ties between them fall
by a hash of doc_id and then at will, which changes no row's size or target.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions.staging import stage
from tillscope.llm.common import WORD, documents, rank_within

MOST = 3.0
#: Rows of one source and size that meet in a task when copies are dealt out, about.
CELL_ROWS = 4_000
PHASES = 32


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.expr(f"regexp_count({text}, r'{WORD}')").cast("long"), F.lit(0).cast("long"))


def source_targets(sources: DataFrame, most: float = MOST) -> DataFrame:
    """Add ``target`` to (source, total): shares by weights 1, 2, 3, 1, ... of the sources in order of code points, null last.

    A target stops at ``most`` times its source's total, and the excess is
    shared by weight among the others until none is above. ``sources`` has one
    row per source; only sums over it come to the driver.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = stage(sources.withColumn("weight", (place % 3 + 1).cast("double")), "weights")
    cap = most * F.col("total")
    share = 0.0
    while True:  # the share of a unit of weight only grows, and each round but the last caps another source
        full = cap <= share * F.col("weight")
        row = sources.agg(F.sum("total"), F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        new = (row[0] - row[1]) / row[2] if row[2] else share
        if not new > share * (1 + 1e-14):
            break
        share = new
    return sources.select("source", "total", F.least(cap, F.lit(share) * F.col("weight")).alias("target"))


def dual(cells: DataFrame, targets: DataFrame, most: float = MOST, tolerance: float = 1e-9, limit: int = 64) -> DataFrame:
    """(source, scale, lambda, full): solve sum(n * size * least(most, exp(lambda * size / scale))) = target for each source.

    Newton steps of at most 1, kept inside the bracket found so far. ``full``
    marks sources whose every document has the highest rate.
    """
    scale = cells.groupBy("source").agg(F.greatest(F.sum(F.col("size") * F.col("n")) / F.sum("n"), F.lit(1e-9)).alias("scale"))  # above 0 for empty texts too
    state = targets.join(scale.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        "source", "target", "scale", (F.col("target") >= most * F.col("total") * (1 - 1e-12)).alias("full"),
        F.coalesce(F.ln(F.col("target") / F.nullif("total", F.lit(0))), F.lit(0.0)).alias("lam"),
        F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(1.0).alias("miss"))
    state = stage(state, "dual")
    z, n = F.col("size") / F.col("scale"), F.col("n") * F.col("size")
    rate = F.exp(F.least(F.col("lam") * z, F.lit(50.0)))
    for _ in range(0, limit, 4):
        for _ in range(4):
            own = cells.select(F.col("source").alias("_s"), "size", "n").join(state, F.col("source").eqNullSafe(F.col("_s")))
            keep = [F.first(c).alias(c) for c in ("target", "scale", "full", "lam", "lo", "hi")]
            s = own.groupBy("source").agg(*keep, F.sum(n * F.least(F.lit(most), rate)).alias("f"),
                                          F.sum(F.when(rate < most, n * z * rate).otherwise(0.0)).alias("slope"))
            over = F.col("f") - F.col("target")
            s = s.withColumn("miss", F.abs(over) / F.greatest("target", F.lit(1.0)))
            s = s.withColumn("lo", F.when(over <= 0, F.greatest("lo", "lam")).otherwise(F.col("lo")))
            s = s.withColumn("hi", F.when(over >= 0, F.least("hi", "lam")).otherwise(F.col("hi")))
            step = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(-over / F.nullif("slope", F.lit(0.0)), -F.signum(over))))
            new = F.col("lam") + step
            mid = F.when((F.col("lo") > float("-inf")) & (F.col("hi") < float("inf")), (F.col("lo") + F.col("hi")) / 2).otherwise(new)
            done = F.col("full") | (F.col("miss") < tolerance)
            s = s.withColumn("lam", F.when(done, F.col("lam")).when((new > F.col("lo")) & (new < F.col("hi")), new).otherwise(mid))
            state = s.select("source", "target", "scale", "full", "lam", "lo", "hi", "miss")
        state = stage(state, "dual")
        if (state.where("not full").agg(F.max("miss")).first()[0] or 0.0) < tolerance:
            break
    return state


def mix(docs: DataFrame, most: float = MOST) -> DataFrame:
    """docs' columns doc_id, source and size, with source_size, target, rate and copies (0 to ``most``)."""
    docs = stage(docs.select("doc_id", "source", size_of().alias("size")), "sizes")
    cells = stage(docs.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    totals = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total"))
    targets = stage(source_targets(totals, most), "targets")
    solved = dual(cells, targets, most)
    rated = cells.join(solved.select(F.col("source").alias("_s"), "scale", "full", "lam"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("full"), F.lit(most)).otherwise(F.least(F.lit(most), F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0)))))
    rated = rated.withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(rate))
    # along the sizes of a source, the copies so far are the rounded sum of rates so far; of several phases the best one counts
    sizes = Window.partitionBy("source").orderBy("size")
    rated = rated.withColumn("upto", F.sum(F.col("n") * F.col("rate")).over(sizes.rowsBetween(Window.unboundedPreceding, 0)))
    rated = stage(rated.withColumn("from", F.col("upto") - F.col("n") * F.col("rate")), "rates")
    whole = lambda u: F.least(F.floor(F.col("upto") + u) - F.floor(F.col("from") + u), F.lit(most) * F.col("n"))
    error = lambda u: F.abs(F.sum(F.col("size") * (whole(u) - F.col("n") * F.col("rate"))))
    phase = rated.groupBy("source").agg(F.least(*(F.struct(error(u), F.lit(u).alias("u")) for u in (k / PHASES for k in range(PHASES)))).alias("best"))
    phase = phase.select(F.col("source").alias("_s"), F.col("best.u").alias("u"))
    rated = rated.join(phase, F.col("source").eqNullSafe(F.col("_s"))).withColumn("give", whole(F.col("u")).cast("long"))
    rated = rated.join(targets.select(F.col("source").alias("_t"), "total", "target"), F.col("source").eqNullSafe(F.col("_t")))
    rated = stage(rated.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "n", "rate", "give", F.col("total").alias("source_size"), "target"), "copies")
    buckets = max(1, -(-docs.count() // CELL_ROWS))
    own = stage(docs.join(rated, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))).drop("_source", "_size"), "rated")
    dealt = rank_within(own, ["source", "size"], F.pmod(F.xxhash64("doc_id"), F.lit(buckets)), [F.xxhash64("doc_id", F.lit(1)), "doc_id"], "place")
    copies = F.expr("give div n") + (F.col("place") < F.col("give") % F.col("n")).cast("long")
    return dealt.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"))


def mixed_rows(docs: DataFrame, inside: str = "") -> DataFrame:
    """The documents, each as often as the mix takes it. ``inside`` is put before column names where these are fields of a struct."""
    keyed = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    copies = mix(keyed.select(F.col("_row").alias("doc_id"), F.col(f"{inside}source").alias("source"), F.col(f"{inside}text").alias("text"))).where("copies > 0").select(F.col("doc_id").alias("_id"), "copies")
    rows = keyed.join(copies, F.col("_row") == F.col("_id"))
    return rows.withColumn("_copy", F.explode(F.expr("sequence(1L, copies)"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_entropy_mix(spark, folder: str) -> DataFrame:
    out = mix(documents(spark, folder))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")
