"""Orders along a key of any size: the latest row before a place (as-of), pieces of overlapping intervals, piecewise cubics.

A window by key alone is one task's work for a key that holds a third of all rows. Here the keys with more than one in HOT of all
rows (fewer than HOT, whatever the size) are cut at their own quantiles into SLICES stretches; windows run inside a stretch. What a stretch
needs of those before or behind it is one row a stretch, at most HOT times SLICES rows in all, and is broadcast. Other keys
are one stretch. The plan is the same whether there are such keys or not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

HOT, SLICES = 64, 64


def key_bounds(rows: DataFrame, by: Sequence[str], at: str) -> DataFrame:
    """(``by``, bounds): the quantiles of ``at`` of the keys with more than one in HOT of all rows. Fewer than HOT rows, which pass the driver."""
    spark = rows.sparkSession
    kinds = StructType([*(rows.schema[c] for c in by), StructField("bounds", ArrayType(rows.schema[at].dataType))])
    total = rows.count()
    hot = rows.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") * HOT > total).drop("_n")
    cuts = F.percentile_approx(at, [i / SLICES for i in range(1, SLICES)], 10_000).alias("bounds")
    found = rows.select(*by, at).join(F.broadcast(hot), list(by), "left_semi").groupBy(*by).agg(cuts).collect()
    return spark.createDataFrame(found, kinds)


def sliced(rows: DataFrame, bounds: DataFrame, by: Sequence[str], at: str) -> DataFrame:
    """``rows`` with _slice, the number of their key's bounds below them."""
    found = rows.join(F.broadcast(bounds), list(by), "left")
    return found.withColumn("_slice", F.coalesce(F.size(F.filter("bounds", lambda b: b < F.col(at))), F.lit(0))).drop("bounds")


def handed_on(rows: DataFrame, bounds: DataFrame, by: Sequence[str], later: bool = False, **values: Column) -> DataFrame:
    """(``by``, _slice, values): aggregates of the slices before each slice of the large keys (behind it: ``later``), one for each of ``values``.

    A value is (aggregate inside a slice, aggregate of those over slices), the second a function of the first's name.
    """
    inside = rows.join(F.broadcast(bounds.select(*by)), list(by), "left_semi").groupBy(*by, "_slice").agg(*(v[0].alias(k) for k, v in values.items()))
    grid = bounds.select(*by, F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("_slice")).join(inside, [*by, "_slice"], "left")
    w = Window.partitionBy(*by).orderBy("_slice")
    w = w.rowsBetween(1, Window.unboundedFollowing) if later else w.rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(grid.select(*by, "_slice", *(v[1](k).over(w).alias(k) for k, v in values.items())))


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, values: Sequence[str], right_at: str | None = None, exact: bool = True, tie: str | None = None, into: str = "found") -> DataFrame:
    """``left`` with a struct ``into`` of ``right``'s ``values``: of the row with the same ``by`` and the greatest ``right_at`` up to ``at``.

    Not ``exact``: only before ``at``. Of rows with equal ``right_at`` the one with the greatest ``tie`` counts. Rows of ``left`` without such
    a row, with a null key or a null ``at``, get null; such rows of ``right`` are never found. Repeated rows of ``left`` are all answered.
    """
    right_at = right_at or at
    complete = lambda t: F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in (*by, t)))
    found_kind = StructType([right.schema[c] for c in values])
    tie_column = F.col(tie) if tie else F.lit(0)
    answers = right.filter(complete(right_at)).select(*by, F.col(right_at).alias("_at"), F.lit(0 if exact else 1).alias("_side"), tie_column.alias("_tie"), F.struct(*values).alias("_right"))
    whole = F.struct(*(F.col(f"`{c}`") for c in left.columns))
    asked = left.filter(complete(at)).select(*by, F.col(at).alias("_at"), F.lit(1 if exact else 0).alias("_side"), whole.alias("_left"))
    rows = answers.unionByName(asked, allowMissingColumns=True)
    bounds = key_bounds(rows.select(*by, "_at"), by, "_at")
    before = handed_on(sliced(answers, bounds, by, "_at"), bounds, by, _before=(F.max_by("_right", F.struct("_at", "_tie")), lambda c: F.last(c, True)))
    w = Window.partitionBy(*by, "_slice").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = sliced(rows, bounds, by, "_at").withColumn("_own", F.last("_right", True).over(w)).filter("_left IS NOT NULL")
    rows = rows.join(before, [*by, "_slice"], "left").select("_left.*", F.coalesce("_own", "_before").alias(into))
    return rows.unionByName(left.filter(~F.coalesce(complete(at), F.lit(False))).withColumn(into, F.lit(None).cast(found_kind)))


def cubic_sections(places: DataFrame, sections: DataFrame, by: Sequence[str], s: str = "s") -> DataFrame:
    """``places`` with ``value``: the cubic a + b t + c t^2 + d t^3 of the last section (``by``, s, a, b, c, d) that begins at or before each place, t from there.

    Places before the first section of their key go by that one; without a section, a place has 0; a null place has null if its key has sections. Of sections that begin alike the one with
    the greatest coefficients counts, in the order a, b, c, d.
    """
    names = ("s", "a", "b", "c", "d")
    sections = sections.withColumn("_all", F.struct("a", "b", "c", "d"))
    found = asof(places, sections, by, s, names, right_at="s", tie="_all", into="_section")
    first = sections.filter("s IS NOT NULL").groupBy(*by).agg(F.min_by(F.struct(*names), F.struct("s", *((-F.col(c)).alias(c) for c in names[1:]))).alias("_first"))
    found = found.join(first, list(by), "left").withColumn("_section", F.coalesce("_section", "_first"))
    c, t = F.col("_section"), F.col(s) - F.col("_section.s")
    value = F.when(c.isNull(), F.lit(0.0)).otherwise(c["a"] + c["b"] * t + c["c"] * t * t + c["d"] * t * t * t)
    return found.withColumn("value", value).drop("_section", "_first")


def interval_pieces(intervals: DataFrame, by: Sequence[str], labels: Sequence[str], begin: str = "begin", end: str = "end", label: str = "label") -> DataFrame:
    """(``by``, begin, end, labels): the longest stretches of a key covered by the same set of labels, in the order of ``labels``.

    An interval holds its beginning and not its end. It counts where it begins and ends and is never copied along its way, so the work follows the
    number of intervals. Stretches that nothing covers are left out. Intervals with a null key, end or label, empty ones and those with other labels say nothing.
    """
    one = lambda c, d: F.struct(F.col(c).alias("p"), F.lit(d).alias("d"))
    rows = intervals.filter(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in by))).filter((F.col(begin) < F.col(end)) & F.col(label).isin(*labels))
    rows = rows.select(*by, F.col(label).alias("_label"), F.explode(F.array(one(begin, 1), one(end, -1))).alias("_e")).select(*by, "_label", "_e.*")
    steps = {f"_n{i}": F.sum(F.when(F.col("_label") == x, F.col("d")).otherwise(0)) for i, x in enumerate(labels)}
    points = rows.groupBy(*by, "p").agg(*(v.alias(k) for k, v in steps.items()))
    bounds = key_bounds(points.select(*by, "p"), by, "p")
    points = sliced(points, bounds, by, "p")
    before = handed_on(points, bounds, by, **{f"_b{k}": (F.sum(k), F.sum) for k in steps})
    w = Window.partitionBy(*by, "_slice").orderBy("p")
    points = points.withColumns({f"_r{k}": F.sum(k).over(w.rowsBetween(Window.unboundedPreceding, 0)) for k in steps}).join(before, [*by, "_slice"], "left")
    after = {k: F.col(f"_r{k}") + F.coalesce(f"_b{k}", F.lit(0)) for k in steps}
    there = lambda count: F.array_compact(F.array(*(F.when(count(k) > 0, F.lit(x)) for k, x in zip(steps, labels))))
    points = points.select(*by, "_slice", "p", there(lambda k: after[k] - F.col(k)).alias("_was"), there(lambda k: after[k]).alias("labels"))
    changes = points.filter(F.col("_was") != F.col("labels"))
    behind = handed_on(changes, bounds, by, later=True, _next=(F.min("p"), F.min))
    pieces = changes.withColumn("_lead", F.lead("p").over(w)).join(behind, [*by, "_slice"], "left")
    return pieces.filter(F.size("labels") > 0).select(*by, F.col("p").alias("begin"), F.coalesce("_lead", "_next").alias("end"), "labels")


def short_pieces_joined(pieces: DataFrame, by: Sequence[str], shortest: int = 1) -> DataFrame:
    """Pieces (``by``, begin, end, labels) with those of length ``shortest`` joined to what lies before, in order: the longer of both gives the labels,
    the one before if they are as long. Pieces with equal labels on the way become one; a gap parts them. The pieces of one key are one row's work.
    """
    ordered = F.sort_array(F.collect_list(F.struct("begin", "end", "labels")))
    size = lambda x: x["end"] - x["begin"]
    joined = lambda a, x, labels: F.struct(a["begin"].alias("begin"), x["end"].alias("end"), labels.alias("labels"))

    def step(done: Column, x: Column) -> Column:
        last, rest = F.try_element_at(done, F.lit(-1)), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        longer = F.when(size(x) > size(last), x["labels"]).otherwise(last["labels"])
        meets = F.coalesce(last["end"] == x["begin"], F.lit(False))
        short = (size(last) <= shortest) | (size(x) <= shortest)
        return F.when(meets & ((last["labels"] == x["labels"]) | short), F.concat(rest, F.array(joined(last, x, longer)))).otherwise(F.concat(done, F.array(x)))

    grouped = pieces.groupBy(*by).agg(ordered.alias("_pieces"))
    kind = grouped.schema["_pieces"].dataType
    folded = F.aggregate("_pieces", F.array().cast(kind), step)
    return grouped.select(*by, F.explode(folded).alias("_p")).select(*by, "_p.*")
