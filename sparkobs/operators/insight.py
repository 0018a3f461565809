"""Health, anomalies, alerts, discovery and diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkobs.operators import measures as M
from sparkobs.plans.panels import bucket

c = F.col
DAY_US = 86_400_000_000


def health(rollup: DataFrame) -> DataFrame:
    """Services over their minutes: weighted error rate and median, worst p95, and a grade."""
    served = F.when(c("served_spans") > 0, c("served_spans"))
    own = rollup.where("spans > 0").groupBy("namespace", "service").agg(
        F.sum("spans").alias("spans"), (F.sum(c("error_rate") * c("spans")) / F.sum("spans")).alias("error_rate"),
        (F.sum(c("p50_ms") * served) / F.sum(served)).alias("p50_ms"), F.max(F.when(c("served_spans") > 0, c("p95_ms"))).alias("p95_ms"),
    )
    grade = F.when((c("error_rate") >= 5) | (c("p95_ms") >= 2000), "unhealthy").when((c("error_rate") >= 1) | (c("p95_ms") >= 750), "degraded").otherwise("healthy")
    return own.withColumn("grade", grade)


def halves(df: DataFrame, time: str, start_us: int, width_us: int, seconds: int) -> DataFrame:
    """Rows of a baseline window and of the equally long current one behind it, with their bucket."""
    own = df.where((c(time) >= start_us) & (c(time) < start_us + 2 * width_us))
    return own.withColumns({"current": c(time) >= start_us + width_us, "bucket_ms": bucket(c(time), seconds)})


def compared(buckets: DataFrame, value: str) -> DataFrame:
    """Mean of the current buckets against mean and deviation of the baseline's, by service."""
    pick = lambda now: F.when(c("current") == now, c(value))
    return buckets.groupBy("namespace", "service").agg(F.avg(pick(True)).alias("now"), F.avg(pick(False)).alias("base"), F.stddev(pick(False)).alias("sd"))


def error_anomalies(spans: DataFrame, start_us: int, width_us: int, seconds: int, least: float = 2.0) -> DataFrame:
    rate = halves(spans, "start_us", start_us, width_us, seconds).groupBy("namespace", "service", "current", "bucket_ms").agg((M.error_rate() / 100).alias("rate"))
    own = compared(rate, "rate").withColumn("z", (c("now") - c("base")) / F.greatest(F.coalesce("sd", F.lit(0.0)), F.lit(0.01)))
    return own.where(F.abs("z") >= least)


def latency_anomalies(spans: DataFrame, start_us: int, width_us: int, seconds: int, least: float = 2.0) -> DataFrame:
    own = halves(spans, "start_us", start_us, width_us, seconds).groupBy("namespace", "service", "current", "bucket_ms").agg(F.percentile("duration_ms", F.lit(0.95)).alias("p95"), F.count(F.lit(1)).alias("n"))
    pick = lambda now, x: F.when(c("current") == now, x)
    mean = lambda now: F.sum(pick(now, c("p95") * c("n"))) / F.sum(pick(now, c("n")))
    own = own.groupBy("namespace", "service").agg(mean(True).alias("now"), mean(False).alias("base"), F.stddev(pick(False, c("p95"))).alias("sd"))
    own = own.withColumn("z", (c("now") - c("base")) / F.greatest(F.coalesce("sd", F.lit(0.0)), F.lit(1.0)))
    return own.where((c("z") >= least) & (c("now") - c("base") >= 5) & (c("now") >= 1.2 * c("base")))


def volume_anomalies(spans: DataFrame, start_us: int, width_us: int, seconds: int, least: float = 2.5) -> DataFrame:
    """Services of either window; one that is absent from a window has none there."""
    own = halves(spans, "start_us", start_us, width_us, seconds).groupBy("namespace", "service", "current", "bucket_ms").agg(F.count(F.lit(1)).cast("double").alias("n"))
    own = compared(own, "n").na.fill(0.0, ["now", "base"]).withColumn("z", (c("now") - c("base")) / F.greatest(F.coalesce("sd", F.lit(0.0)), F.lit(1.0)))
    return own.where((F.abs("z") >= least) & (F.abs(c("now") - c("base")) >= 0.25 * c("base")))


def merged_episodes(episodes: DataFrame) -> DataFrame:
    """Episodes (namespace, service, kind, start_us, end_us, title) of one kind that touch become one; the newest title stands.

    Episodes that start on one day merge first, so a kind's last pass sees what each day left and not every episode."""

    def merged(rows: DataFrame, *key: str) -> DataFrame:
        w = Window.partitionBy(*key).orderBy("start_us", "end_us")
        seen = F.max("end_us").over(w.rowsBetween(Window.unboundedPreceding, -1))
        own = rows.withColumn("new", F.coalesce(c("start_us") > seen, F.lit(True)).cast("int")).withColumn("nth", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return own.groupBy(*key, "nth").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.max_by(F.struct("title", "newest"), "newest").alias("x")).select(*key, "start_us", "end_us", "x.*")

    key = ["namespace", "service", "kind"]
    days = episodes.select(*key, "start_us", "end_us", "title", F.struct("start_us", "end_us").alias("newest"), F.floor(c("start_us") / DAY_US).alias("day"))
    return merged(merged(days, *key, "day"), *key).drop("newest")


def alert_env(rollup: DataFrame, end_ms: Column | None = None, minutes: int = 5) -> DataFrame:
    """Means of the last minutes (up to ``end_ms``, else the newest there are) by service, and their change in percent against the minutes before (0 without a baseline)."""
    width = minutes * 60_000
    end_ms = rollup.agg(F.max("bucket_ms") + 60_000).scalar() if end_ms is None else end_ms
    mean = lambda rows, suffix: rows.groupBy("namespace", "service").agg(F.avg("error_rate").alias(f"error_rate{suffix}"), F.avg("p95_ms").alias(f"p95_ms{suffix}"), F.avg("spans").alias(f"spans{suffix}"))
    now = mean(rollup.where((c("bucket_ms") >= end_ms - width) & (c("bucket_ms") < end_ms)), "")
    before = mean(rollup.where((c("bucket_ms") >= end_ms - 2 * width) & (c("bucket_ms") < end_ms - width)), "_before")
    own = now.join(before, ["namespace", "service"], "left")
    change = lambda x: F.coalesce(F.lit(100.0) * (c(x) - c(f"{x}_before")) / F.nullif(c(f"{x}_before"), F.lit(0.0)), F.lit(0.0))
    return own.select("namespace", "service", "error_rate", "p95_ms", "spans", *(change(x).alias(f"{x}_change") for x in ("error_rate", "p95_ms", "spans")))


def top_values(df: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """The most frequent values of every column, counted in one pass over the unpivoted rows."""
    long = df.select(*(c(x).cast("string").alias(x) for x in columns)).unpivot([], columns, "name", "value").where("value is not null")
    counts = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "value"))  # each task keeps its own first ``top`` before the shuffle
    return counts.withColumn("rank", rank).where(c("rank") <= top).select("name", "rank", "value", "n")


def diagnosis(df: DataFrame, entries: dict[str, Column]) -> DataFrame:
    """For each filter entry, the rows that meet all the others, and those that meet it alone, in one pass."""
    def every(but: str | None) -> Column:
        out = F.lit(True)
        for k, p in entries.items():
            out = out if k == but else out & F.coalesce(p, F.lit(False))
        return out

    cells = [F.struct(F.lit(k).alias("entry"), F.count_if(every(k)).alias("without"), F.count_if(F.coalesce(p, F.lit(False))).alias("alone")) for k, p in entries.items()]
    return df.agg(F.array(*cells).alias("x")).select(F.inline("x"))


def culprit(counts: DataFrame) -> DataFrame:
    """Of a diagnosis, the entry without which most rows would be left; none if no single entry is to blame."""
    return counts.where("without > 0").orderBy(F.desc("without"), "entry").limit(1)


def nearest(df: DataFrame, field: str, wanted: str, top: int = 3) -> DataFrame:
    """Values closest to what was asked, by edit distance."""
    own = df.groupBy(c(field).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("value is not null")
    return own.withColumn("distance", F.levenshtein(F.lower("value"), F.lit(wanted.lower()))).orderBy("distance", F.desc("n"), "value").limit(top)


def inventory(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Distinct identities with when they were first and last seen."""
    return df.groupBy(*keys).agg(F.min(time).alias("first_us"), F.max(time).alias("last_us"), F.count(F.lit(1)).alias("n"))


def discovered(df: DataFrame, bag: str) -> DataFrame:
    """Keys of a bag of attributes (JSON text or a map of texts): how often each is there, its distinct values, and how many are numbers, from what to what."""
    pairs = F.from_json(bag, "map<string,string>") if dict(df.dtypes)[bag] == "string" else c(bag)
    own = df.select(F.explode(pairs).alias("name", "value")).where("value is not null").withColumn("number", c("value").try_cast("double"))
    return own.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("values"), F.count("number").alias("numbers"), F.min("number").alias("lo"), F.max("number").alias("hi"))


def health_trend(rollup: DataFrame, seconds: int) -> DataFrame:
    """Error rate of all services by bucket, weighted by spans."""
    at = F.floor(c("bucket_ms") / (seconds * 1000)).cast("long") * (seconds * 1000)
    return rollup.groupBy(at.alias("at_ms")).agg(F.coalesce(F.sum(c("error_rate") * c("spans")) / F.nullif(F.sum("spans"), F.lit(0)), F.lit(0.0)).alias("error_rate"))


def repeated_patterns(logs: DataFrame, template: Column, start_us: int, end_us: int, least: int = 3, top: int = 50) -> DataFrame:
    """Templates of warnings and errors that repeat, by severity and service."""
    own = logs.where((c("time_us") >= start_us) & (c("time_us") < end_us) & c("severity").isin("WARN", "ERROR", "FATAL"))
    counts = own.groupBy(F.coalesce(template, F.lit("")).alias("template"), "severity", "service").agg(F.count(F.lit(1)).alias("n"), F.min("time_us").alias("first_us"), F.max("time_us").alias("last_us"))
    return counts.where(c("n") >= least).orderBy(F.desc("n"), "template", "severity", "service").limit(top)


def health_score(anomalies: DataFrame, patterns: DataFrame) -> DataFrame:
    """100, less 15, 10 or 5 for each anomaly by its z, less 5 for each frequent error pattern and 2 for each of warnings; 0 at least."""
    z = F.abs("z")
    a = anomalies.select(F.when(z >= 3, 15.0).when(z >= 2.5, 10.0).when(z >= 2, 5.0).otherwise(0.0).alias("penalty"))
    b = patterns.select(F.when((c("severity") == "ERROR") & (c("n") >= 10), 5.0).when((c("severity") == "WARN") & (c("n") >= 20), 2.0).otherwise(0.0).alias("penalty"))
    return a.unionAll(b).agg(F.greatest(F.lit(0.0), F.lit(100.0) - F.coalesce(F.sum("penalty"), F.lit(0.0))).alias("score"))


def annotations(deploys: DataFrame, episodes: DataFrame, start_us: int, end_us: int, top: int = 1000) -> DataFrame:
    """Deploys in a window and anomalies that overlap it, newest first, ``top`` of each."""
    d = deploys.where((c("deploy_us") >= start_us) & (c("deploy_us") < end_us)).orderBy(F.desc("deploy_us"), "namespace", "service", "service_version").limit(top)
    e = episodes.where((c("end_us") > start_us) & (c("start_us") < end_us)).orderBy(F.desc("end_us"), "namespace", "service", "kind").limit(top)
    shown = d.select("namespace", "service", F.lit("deploy").alias("kind"), c("deploy_us").alias("from_us"), c("deploy_us").alias("to_us"), c("service_version").alias("title"))
    return shown.unionByName(e.select("namespace", "service", "kind", c("start_us").alias("from_us"), c("end_us").alias("to_us"), "title"))
