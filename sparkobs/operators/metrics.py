"""Metric kinds: retry dedup, increases with resets, spreading over buckets, carries, last values, histograms.

All clocks are microseconds. A point has a series, a time and an ingest stamp; windows are by series, so series spread
over the cluster and only one series' points ever share a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOOKBACK_US, STALE_US = 600_000_000, 300_000_000
c = F.col


def deduped(points: DataFrame) -> DataFrame:
    """The last sent of the points of one series and time; of equal stamps the larger value."""
    rest = F.struct(*(x for x in points.columns if x not in ("series", "time_us")))
    best = points.groupBy("series", "time_us").agg(F.max_by(rest, F.struct("ingested", "value")).alias("x"))
    return best.select("series", "time_us", "x.*")


def valid(points: DataFrame) -> DataFrame:
    """Points that can be measured: finite values, and histograms whose counts fit their bounds or that have neither."""
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    number = (c("type") != "histogram") & finite(c("value"))
    fits = (F.size("counts") == F.size("bounds") + 1) | (F.size("counts") == 0) & (F.size("bounds") == 0)
    return points.where(number | (c("type") == "histogram") & (c("sum").isNull() | finite(c("sum"))) & fits)


def delta(points: DataFrame, cumulative: bool) -> Column:
    """Whether a point counts since its start or the point before it: by its temporality, where points carry one."""
    return F.coalesce(c("temporality") == "delta", F.lit(False)) if "temporality" in points.columns else F.lit(not cumulative)


def increases(points: DataFrame, cumulative: bool = True) -> DataFrame:
    """inc, from_us and elapsed_us of every point; a cumulative point without one before yields none.

    A counter is reset where its start changes or its value falls; then the value itself is the increase."""
    w = Window.partitionBy("series").orderBy("time_us", "ingested")
    own = points.withColumns({"p_time": F.lag("time_us").over(w), "p_value": F.lag("value").over(w), "p_start": F.lag("start_us").over(w), "delta": delta(points, cumulative)})
    reset = ~c("delta") & (F.coalesce(c("start_us") != c("p_start"), F.lit(False)) | F.coalesce(c("value") < c("p_value"), F.lit(False)))
    own = own.where("delta or p_time is not null").withColumns({"reset": reset, "from_us": F.when(c("delta") & (c("start_us") < c("time_us")), c("start_us")).otherwise(c("p_time"))})
    inc = F.when(c("delta") | c("reset"), c("value")).otherwise(c("value") - c("p_value"))
    elapsed = c("time_us") - c("from_us")
    return own.select("series", "time_us", "reset", inc.alias("inc"), "from_us", F.when(elapsed > 0, elapsed).alias("elapsed_us"))


def spread(increase: DataFrame, seconds: int, **parts: str) -> DataFrame:
    """Parts of each increase by bucket, in proportion to overlap; gaps above LOOKBACK_US stay with their point's bucket.

    ``parts`` names what is shared out, numbers or arrays of them (by default the column inc, as part); other columns stay."""
    parts, width = parts or {"part": "inc"}, seconds * 1_000_000
    fits = c("elapsed_us").isNotNull() & (c("elapsed_us") <= LOOKBACK_US)
    at = lambda t: F.floor(t / width).cast("long")
    own = increase.withColumn("fits", fits).withColumn("i", F.explode(F.sequence(F.when(fits, at(c("from_us"))).otherwise(at(c("time_us"))), F.when(fits, at(c("time_us") - 1)).otherwise(at(c("time_us"))))))
    overlap = F.least(c("time_us"), (c("i") + 1) * width) - F.greatest(c("from_us"), c("i") * width)
    share = lambda x: F.when(c("fits"), x * overlap / c("elapsed_us")).otherwise(x.cast("double"))
    each = lambda name: F.transform(name, share) if dict(increase.dtypes)[name].startswith("array") else share(c(name))
    kept = [x for x in increase.columns if x not in (*parts.values(), "reset", "from_us", "elapsed_us")]
    return own.select(*kept, (c("i") * (seconds * 1000)).alias("bucket_ms"), *(each(name).alias(k) for k, name in parts.items()), F.when(c("fits"), overlap).otherwise(c("elapsed_us")).alias("covered_us"))


def rates(parts: DataFrame) -> DataFrame:
    """Per second, by series and bucket; only covered time counts."""
    own = parts.where("covered_us > 0").groupBy("series", "bucket_ms").agg((F.sum("part") / (F.sum("covered_us") / 1e6)).alias("rate"))
    return own


def carried_rates(parts: DataFrame, seconds: int) -> DataFrame:
    """Rates by series and bucket, and in buckets without covered time the rate of the last increase, if that ended no longer than STALE_US before the bucket's start."""
    width = seconds * 1_000_000
    own = parts.where("covered_us > 0").withColumn("i", (c("bucket_ms") / (seconds * 1000)).cast("long"))
    own = own.groupBy("series", "i").agg((F.sum("part") / (F.sum("covered_us") / 1e6)).alias("rate"), F.max_by(c("part") / (c("covered_us") / 1e6), "time_us").alias("last"), F.max("time_us").alias("time_us"))
    own = own.withColumn("until", F.least(F.coalesce(F.lead("i").over(Window.partitionBy("series").orderBy("i")), F.lit(2**40)) - 1, F.floor((c("time_us") + STALE_US) / width)).cast("long"))
    filled = own.where("until > i").select("series", F.explode(F.sequence(c("i") + 1, c("until"))).alias("i"), c("last").alias("rate"), F.lit(1).alias("is_carried"))
    return own.select("series", "i", "rate", F.lit(0).alias("is_carried")).unionByName(filled).select("series", (c("i") * (seconds * 1000)).alias("bucket_ms"), "rate", "is_carried")


def last_at(points: DataFrame, seconds: int, start_us: int, end_us: int) -> DataFrame:
    """The newest value of each series at every bucket's end, if no older than STALE_US: an as-of join.

    Every point is newest for the bucket ends after it, up to its successor or until it is stale; those few ends are
    spelled out, so no grid meets all points."""
    width = seconds * 1_000_000
    w = Window.partitionBy("series").orderBy("time_us", "ingested")
    own = points.withColumn("next_us", F.lead("time_us").over(w))
    # ends e with time < e <= time + STALE, and e <= the next point's time (which is not before e)
    first = F.floor(c("time_us") / width) + 1
    final = F.floor(F.least(c("time_us") + STALE_US, F.coalesce(c("next_us"), F.lit(2**62)), F.lit(end_us)) / width)
    own = own.withColumns({"a": F.greatest(first, F.lit(start_us // width + 1)).cast("long"), "b": final.cast("long")}).where("a <= b")
    return own.select("series", F.explode(F.sequence("a", "b")).alias("i"), "value").select("series", ((c("i") - 1) * (seconds * 1000)).alias("bucket_ms"), "value")


def carried(points: DataFrame, seconds: int) -> DataFrame:
    """Mean by series and bucket; a bucket without points takes the last point's value if that is no older than STALE_US at its start."""
    width = seconds * 1_000_000
    bucket = F.floor(c("time_us") / width).cast("long")
    means = points.groupBy("series", bucket.alias("i")).agg(F.avg("value").alias("mean"), F.max_by("value", F.struct("time_us", "ingested")).alias("value"), F.max("time_us").alias("time_us"))
    w = Window.partitionBy("series").orderBy("i")
    own = means.withColumn("next_i", F.coalesce(F.lead("i").over(w), F.lit(2**40)))
    until = F.least(c("next_i") - 1, F.floor((c("time_us") + STALE_US) / width)).cast("long")
    filled = own.withColumn("until", until).where("until > i").select("series", F.explode(F.sequence(c("i") + 1, c("until"))).alias("i"), c("value").alias("mean"), F.lit(1).alias("is_carried"))
    out = own.select("series", "i", "mean", F.lit(0).alias("is_carried")).unionByName(filled)
    return out.select("series", (c("i") * (seconds * 1000)).alias("bucket_ms"), "mean", "is_carried")


def rebinned(counts: Column, old: Column, new: Column) -> Column:
    """Counts of whole old buckets that lie inside each new bucket."""
    low = lambda b, i: F.when(i == 0, F.lit(float("-inf"))).otherwise(F.get(b, i - 1))
    high = lambda b, i: F.coalesce(F.get(b, i), F.lit(float("inf")))
    cells = F.sequence(F.lit(0), F.size(new))
    inside = lambda j: F.aggregate(F.sequence(F.lit(0), F.size(old)), F.lit(0).cast("long"), lambda s, i: s + F.when((low(new, j) <= low(old, i)) & (high(old, i) <= high(new, j)), F.get(counts, i)).otherwise(0))
    return F.transform(cells, inside)


def histogram_increases(points: DataFrame, cumulative: bool = True) -> DataFrame:
    """Bucket counts, sums and totals gained since the point before; changed bounds are matched, lost mass or another start is a reset.

    Sums that are not finite take their point out; ``count`` and ``start_us`` are used where points carry them."""
    w, has = Window.partitionBy("series").orderBy("time_us", "ingested"), set(points.columns)
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
    fits = (F.size("counts") == F.size("bounds") + 1) | (F.size("counts") == 0) & (F.size("bounds") == 0)
    own = points.where(fits & (c("sum").isNull() | ~F.isnan(c("sum").cast("double")) & (F.abs("sum") < float("inf"))))
    own = own.withColumns({"n": c("count") if "count" in has else total(c("counts")), "begun": c("start_us") if "start_us" in has else F.lit(None).cast("long"), "delta": delta(points, cumulative)})
    own = own.withColumns({f"p_{x}": F.lag(x).over(w) for x in ("counts", "bounds", "sum", "n", "begun", "time_us")}).where("delta or p_counts is not null")
    same = c("bounds") == c("p_bounds")
    own = own.withColumn("was", F.when(same, c("p_counts")).otherwise(rebinned(c("p_counts"), c("p_bounds"), c("bounds"))))
    own = own.withColumn("diff", F.zip_with("counts", "was", lambda a, b: a - b))
    reset = F.coalesce(c("begun") != c("p_begun"), F.lit(False)) | (c("n") < c("p_n")) | ~same & (total(c("was")) != total(c("p_counts"))) | F.exists("diff", lambda x: x < 0)
    own = own.withColumns({"reset": ~c("delta") & F.coalesce(reset, F.lit(False)), "from_us": F.when(c("delta") & (c("begun") < c("time_us")), c("begun")).otherwise(c("p_time_us"))})
    since = lambda x, old: F.when(c("delta") | c("reset"), x).otherwise(old)
    elapsed = c("time_us") - c("from_us")
    return own.select(
        "series", "time_us", "bounds", "reset", since(c("counts"), c("diff")).alias("gained"), since(c("sum"), c("sum") - c("p_sum")).alias("sum_inc"), since(c("n"), c("n") - c("p_n")).alias("count_inc"),
        "from_us", F.when(elapsed > 0, elapsed).alias("elapsed_us"),
    )


def bucket_weights(gains: DataFrame, *keys: str) -> DataFrame:
    """Weight by upper bound (null: no bound) over all series."""
    pairs = F.arrays_zip(F.array_append("bounds", F.lit(None).cast("double")).alias("hi"), c("gained").alias("n"))
    return gains.select(*keys, F.inline(pairs)).groupBy(*keys, "hi").agg(F.sum("n").alias("n"))


def bucket_quantile(weights: DataFrame, q: float, *keys: str) -> DataFrame:
    """Linear within the first bucket whose cumulative weight reaches q; the open bucket gives the highest bound."""
    order = F.asc_nulls_last("hi")
    w = Window.partitionBy(*keys).orderBy(order)
    every = Window.partitionBy(*keys)
    own = weights.withColumns({"cum": F.sum("n").over(w), "total": F.sum("n").over(every), "lo": F.coalesce(F.lag("hi").over(w), F.lit(0.0)), "top": F.max("hi").over(every)})
    own = own.where((c("n") > 0) & (c("cum") >= c("total") * q))
    part = c("lo") + (c("total") * q - (c("cum") - c("n"))) / c("n") * (c("hi") - c("lo"))
    first = F.when(c("hi").isNull(), c("top")).when((c("hi") <= 0), c("hi")).otherwise(part)
    return own.groupBy(*keys).agg(F.min_by(first, F.struct("cum", F.coalesce("hi", F.lit(float("inf"))))).alias("value"))


def exponential(values: DataFrame, scale: int, *keys: str) -> DataFrame:
    """Exponential histograms of the finite values: buckets of those above 0, zeros, and buckets of those below 0 by magnitude.

    Bucket i holds magnitudes from 2**(i * 2**-scale) up to the next bound; zeros have no logarithm and are only counted."""
    value = c("value")
    i = F.when(value != 0, F.floor(F.log2(F.abs(value)) * 2.0**scale).cast("int"))
    own = values.where(~F.isnan(value) & (F.abs(value) < float("inf"))).groupBy(*keys, F.signum(value).alias("sign"), i.alias("i")).agg(F.count(F.lit(1)).alias("n"))
    sides = {"positive": c("sign") > 0, "negative": c("sign") < 0}
    low = {f"{k}_offset": F.min(F.when(on, c("i"))) for k, on in sides.items()}
    high = {f"{k}_high": F.max(F.when(on, c("i"))) for k, on in sides.items()}
    held = {f"{k}_held": F.map_from_entries(F.collect_list(F.when(on, F.struct("i", "n")))) for k, on in sides.items()}
    own = own.groupBy(*keys).agg(F.coalesce(F.sum(F.when(c("sign") == 0, c("n"))), F.lit(0).cast("long")).alias("zero_count"), *(x.alias(k) for k, x in (low | high | held).items()))
    none = F.array().cast("array<bigint>")
    counts = lambda k: F.coalesce(F.transform(F.sequence(f"{k}_offset", f"{k}_high"), lambda j: F.coalesce(F.element_at(f"{k}_held", j), F.lit(0).cast("long"))), none)
    filled = [x for k in sides for x in (F.coalesce(f"{k}_offset", F.lit(0)).alias(f"{k}_offset"), counts(k).alias(f"{k}_counts"))]
    return own.select(*keys, F.lit(scale).alias("scale"), "zero_count", F.lit(0.0).alias("zero_threshold"), *filled)


def explicit(scale: Column, offset: Column, counts: Column) -> Column:
    """Upper bounds of the positive buckets of an exponential histogram: 2**((offset + i + 1) * 2**-scale)."""
    return F.transform(counts, lambda _, i: F.pow(F.lit(2.0), (offset + i + 1) * F.pow(F.lit(2.0), -scale)))


def decoded(points: DataFrame) -> DataFrame:
    """bounds and counts of exponential histograms (scale, zero_count, zero_threshold, positive and negative offset and counts).

    Negative buckets come first, largest magnitude first, then the zero bucket, then the positive ones; bounds that are
    not finite or not above the one before give their counts to the next."""
    up = explicit(c("scale"), c("positive_offset"), c("positive_counts"))
    # an upper bound of a negative bucket is the negated lower bound of its mirror image
    down = F.reverse(F.transform("negative_counts", lambda _, i: -F.pow(F.lit(2.0), (c("negative_offset") + i) * F.pow(F.lit(2.0), -c("scale")))))
    zero = F.coalesce("zero_threshold", F.lit(0.0))
    bounds = F.concat(down, F.array(zero), up)
    counts = F.concat(F.reverse("negative_counts"), F.array(c("zero_count")), c("positive_counts"))
    start = F.struct(F.array().cast("array<double>").alias("b"), F.array().cast("array<bigint>").alias("n"), F.lit(0).cast("long").alias("held"))

    def step(s: Column, x: Column) -> Column:
        fits = ~F.isnan(x["hi"]) & (F.abs(x["hi"]) < float("inf")) & ((F.size(s["b"]) == 0) | (x["hi"] > F.element_at(s["b"], -1)))
        n = s["held"] + x["n"]
        return F.struct(F.when(fits, F.array_append(s["b"], x["hi"])).otherwise(s["b"]).alias("b"), F.when(fits, F.array_append(s["n"], n)).otherwise(s["n"]).alias("n"), F.when(fits, F.lit(0).cast("long")).otherwise(n).alias("held"))

    pairs = F.arrays_zip(bounds.alias("hi"), counts.alias("n"))
    own = points.withColumn("__x", F.aggregate(pairs, start, step, lambda s: F.struct(s["b"].alias("bounds"), F.array_append(s["n"], s["held"]).alias("counts"))))
    return own.select(*points.columns, "__x.bounds", "__x.counts")
