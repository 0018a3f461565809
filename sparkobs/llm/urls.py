"""URL filter: host rules, and a character language-model ratio where no rule fits.

Smoothed variable-order Markov models of accepted and of rejected urls are counted over all rows that a rule decides.
A url's score is the difference of the two log-likelihoods divided by its length; the threshold is calibrated on the
rule-decided urls that the other fold's models score. The longest context and its character are five bytes and so an
exact number, a gram, of which the shorter ones are parts: counts of grams are a table that grows with the urls, shorter
contexts are sums over it, and a url's score is the sum of its grams' ratios, found by a join.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule, and is scored as its text
(null: the empty text, score 0); repeated urls get equal verdicts; very long urls are scored whole, in segments; of
thresholds that err alike the one nearest 0 holds, and a score that equals it is allowed; without urls of both kinds
every score is 0 and the verdict is ``allow``; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkobs.llm.common import slices, stored
from sparkobs.llm.jaccard import lookup

#: Contexts of 0 to ORDER characters; the weight of the longest is its count over the count plus STRENGTH.
ORDER, STRENGTH, ALPHABET = 4, 4.0, 256
UNIT = float(1 << 30)  # ratios are added as integers of this fraction of a bit, in any order with the same sum
MODELS = [f"{f}_{m}" for f in (0, 1) for m in (0, 1)]  # fold, and 0 rejected or 1 accepted
BINS, SPAN = 2000, 4.0  # the calibration's histogram: scores in bits a character, from -SPAN to SPAN
SEGMENT = 250_000  # characters whose grams a task holds at once, some 100 bytes each; a bound of memory alone
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it has none."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (host/path) that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is tried last and so wins
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def segments(url: str) -> list[bytes]:
    """The url's bytes between its ends, in parts of SEGMENT characters behind the ORDER that precede them."""
    raw = b"\x02" * ORDER + url.encode() + b"\x03"
    return [raw[i : i + SEGMENT + ORDER] for i in range(0, len(raw) - ORDER, SEGMENT)]


def grams(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each order a row of contexts and a row of contexts with their character, over all characters of segments; and whose each is."""
    sizes = np.array([len(r) - ORDER for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    whose = np.repeat(np.arange(len(raw)), sizes)
    at = np.arange(len(whose)) + ORDER * (whose + 1)
    contexts = np.zeros((ORDER + 1, len(at)), np.int64)
    for order in range(1, ORDER + 1):
        contexts[order] = contexts[order - 1] | data[at - order] << 8 * (order - 1)
    return contexts, contexts << 8 | data[at], whose


def gram_rows(urls: DataFrame) -> DataFrame:
    """uid, times, accepted, fold, gram and n of the distinct grams of each of ``urls``, by segment where a url has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "url", SEGMENT):
            parts = [(i, x) for i, u in enumerate(b.column("url").to_pylist()) for x in segments(u)]
            at = 0
            while at < len(parts):
                end, size = at, 0
                while end < len(parts) and (end == at or size + len(parts[end][1]) <= 2 * SEGMENT):
                    size, end = size + len(parts[end][1]), end + 1
                _, chars, whose = grams([x for _, x in parts[at:end]])
                order = np.lexsort((chars[ORDER], whose))
                own, whose = chars[ORDER][order], whose[order]
                starts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (whose[1:] != whose[:-1])]))
                rows = pa.array(np.array([i for i, _ in parts[at:end]])[whose[starts]])
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in kept), pa.array(own[starts]), pa.array(np.diff(np.append(starts, len(own))))], names=[*kept, "gram", "n"])
                at = end

    kept = ["uid", "times", "accepted", "fold"]
    return urls.select("url", *kept).mapInArrow(run, "uid long, times long, accepted int, fold int, gram long, n long")


def part(of: str, bytes_: int, skip: int = 0) -> Column:
    """The last ``bytes_`` bytes of a gram without the ``skip`` last ones."""
    return F.shiftright(of, 8 * skip).bitwiseAND(F.lit((1 << 8 * bytes_) - 1).cast("long"))


def ratios(counts: DataFrame) -> DataFrame:
    """gram and the ratio of its log-likelihoods, in units, by the models of fold 0, of fold 1 and of both; ``counts``: gram and a count for each of MODELS.

    Longer contexts correct shorter ones by how often they occurred."""
    names = [*MODELS, "both_0", "both_1"]
    counts = counts.select("gram", *MODELS, *((F.col(f"0_{m}") + F.col(f"1_{m}")).alias(f"both_{m}") for m in (0, 1)))
    out = counts.select("gram", *(F.lit(1 / ALPHABET).alias(f"p_{x}") for x in names))
    for order in range(ORDER + 1):
        for kind, size, key in (("n", order, part("gram", order, 1)), ("k", order + 1, part("gram", order + 1))):
            sums = counts.groupBy(key.alias("key")).agg(*(F.sum(x).alias(f"{kind}_{x}") for x in names))
            # keys of up to two bytes are 65,536 at most
            out = out.withColumn("key", key).join(F.broadcast(sums) if size <= 2 else sums, "key").drop("key")
        out = out.select("gram", *(((F.col(f"k_{x}") + STRENGTH * F.col(f"p_{x}")) / (F.col(f"n_{x}") + STRENGTH)).alias(f"p_{x}") for x in names))
    return out.select("gram", *(F.round((F.log2(f"p_{f}_1") - F.log2(f"p_{f}_0")) * UNIT).cast("long").alias(f"r_{f}") for f in ("0", "1", "both")))


def judge(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, score and verdict of every row."""
    host, path = split(F.col("url"))
    rule, says = ruled(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url")).withColumns({"host": host, "path": path}).withColumns({"rule": rule, "says": says})
    fold = F.pmod(F.xxhash64("url"), F.lit(2)).cast("int")
    urls = rows.groupBy(F.coalesce("url", F.lit("")).alias("url")).agg(F.count(F.lit(1)).alias("times"), F.max(F.when(F.col("says").isNotNull(), (F.col("says") == "allow").cast("int"))).alias("accepted"))
    urls = stored(urls.select(F.monotonically_increasing_id().alias("uid"), "url", "times", "accepted", fold.alias("fold")), "urls")
    usable = urls.where("accepted is not null").select("accepted").distinct().count() == 2
    if not usable:
        return rows.select(F.col("id").alias(key), "host", "path", "rule", F.coalesce("says", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    own = stored(gram_rows(urls), "grams")
    # grams of urls that no rule decides count 0, and get the ratios of their shorter contexts
    counts = own.groupBy("gram").agg(*(F.sum(F.when((F.col("fold") == int(x[0])) & (F.col("accepted") == int(x[2])), F.col("n") * F.col("times")).otherwise(0)).alias(x) for x in MODELS))
    table = stored(ratios(stored(counts, "counts")), "ratios")
    added = lookup(own.select("uid", "gram", "n"), table, "gram", "uid").groupBy("uid").agg(F.sum("n").alias("size"), *(F.sum(F.col("n") * F.col(f"r_{f}")).alias(f"r_{f}") for f in ("0", "1", "both")))
    other = F.when(F.col("fold") == 0, F.col("r_1")).otherwise(F.col("r_0"))  # by the fold that did not count them
    score = F.when(F.col("url") == "", 0.0).otherwise(F.col("r_both") / UNIT / F.col("size"))
    scored = stored(urls.join(added, "uid").select("url", "times", "accepted", (other / UNIT / F.col("size")).alias("across"), score.alias("score")), "scored")
    at = F.least(F.greatest(F.floor((F.col("across") + SPAN) * BINS / (2 * SPAN)), F.lit(0)), F.lit(BINS - 1))
    hist = scored.where("accepted is not null").groupBy((F.col("accepted") * BINS + at).cast("long").alias("bin")).agg(F.sum("times").alias("n")).toPandas()  # 2 * BINS rows at most
    tally = np.zeros(2 * BINS)
    tally[hist.bin.to_numpy()] = hist.n.to_numpy()
    rejected, accepted = tally.reshape(2, BINS)
    # a cut before bin b rejects what lies below: the mean of both error rates is least, ties go to the cut nearest 0
    errors = np.concatenate([[0], np.cumsum(accepted)]) / max(1, accepted.sum()) + 1 - np.concatenate([[0], np.cumsum(rejected)]) / max(1, rejected.sum())
    cuts = np.arange(BINS + 1) * 2 * SPAN / BINS - SPAN
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    threshold = float(cuts[best[np.abs(cuts[best]).argmin()]])
    judged = lookup(rows.withColumn("url", F.coalesce("url", F.lit(""))), scored.select("url", "score"), "url", "id", "left")
    return judged.select(F.col("id").alias(key), "host", "path", "rule", F.coalesce("says", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"), "score")
