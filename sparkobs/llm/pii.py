"""Personal data in DataFrame functions alone: patterns propose spans, checksums confirm them, nearby words adjust a score.

A kind's matches are leftmost and do not overlap; positions follow from the lengths of the matches and of the gaps
between them, in code points. Patterns are written so that no run of characters is tried twice; sums and cuts over the
n spans of a text take n to the power of 1.5 small steps, so texts of any length are searched whole.

Spans of the base kinds stay whatever their score; of the kinds that the method adds, those stay whose score of pattern,
checksum and context reaches LEAST: an IBAN with right check digits unless its context speaks against it, a social
security number only if its context speaks for it.

Defined results: a null text is the empty one, without spans; equal texts have equal spans and scores; spans of
different kinds may overlap; of equal starts the kind listed first comes first; an empty table gives an empty table; of
other columns ``spans`` and ``redact`` keep all, whatever their names, but for one with the name of the output.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkobs.functions.text import let


@dataclass(frozen=True)
class Kind:
    """pattern: proposes; hint: a literal without which a text has no match; sure: score without context; near: words before a span that add to it; base: spans stay whatever their score."""

    name: str
    pattern: str
    hint: str
    sure: float
    near: str
    base: bool = True


# A match starts where the last one ended or where no character of its first run stands before it: a run that failed
# from its start fails from every later one as well.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, r"mail|contact|write"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", ".", 0.6, r"\bip\b|host|server|address"),
    Kind("card", r"[0-9]++(?:[\x20-][0-9]++)*+", "", 0.8, r"card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, r"phone|tel|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", 0.6, r"iban|account|bank", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, r"ssn|social|security|insurance", False),
)
CONTEXT, BONUS, MALUS, AGAINST, LEAST = 40, 0.3, 0.2, r"version|release|order no|isbn|serial", 0.5
SPANS = "array<struct<start:int,order:int,end:int,kind:string,text:string,score:double>>"
BYTE = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def mod97(x: Column) -> Column:
    """Whether an IBAN's check digits hold: the first four characters move to the end, letters count 10 to 35."""
    bare = F.regexp_replace(x, r"\x20", "")
    chars = F.split(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4)), "")
    values = F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(values, F.lit(0), lambda r, v: (F.when(v < 10, r * 10).otherwise(r * 100) + v) % 97)
    return F.length(bare).between(15, 34) & (rest == 1)


def confirmed(kind: str, hit: Column) -> Column:
    n = F.length(digits(hit))
    return {
        "ip": F.forall(F.split(hit, r"\."), lambda p: p.rlike(BYTE)),
        "card": n.between(12, 19) & F.call_function("luhn_check", digits(hit)),
        "phone": n.between(9, 15),
        "iban": mod97(hit),
    }.get(kind, F.lit(True))


def running(xs: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What ``join`` makes of all elements up to each one (ints, 0 before the first).

    Blocks of about the root of their number go one by one: arrays are rebuilt for elements of a block, never of all."""
    none = F.array().cast("array<int>")
    last = lambda ys: F.coalesce(F.get(ys, F.size(ys) - 1), F.lit(0))
    each = lambda ys: F.aggregate(ys, none, lambda s, x: F.array_append(s, join(last(s), x)))

    def joined(blocks: Column) -> Column:
        ends = each(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), join)))
        before = F.concat(F.array(F.lit(0)), ends)
        return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda b, s: F.transform(each(b), lambda x: join(s, x))))

    return F.when(F.size(xs) > 0, let(let(xs, in_blocks), joined)).otherwise(none)


def in_blocks(xs: Column) -> Column:
    """``xs``, not empty, in arrays of about the root of its size."""
    step = F.ceil(F.sqrt(F.size(xs))).cast("int")
    return F.transform(F.sequence(F.lit(1), F.size(xs), step), lambda i: F.slice(xs, i, step))


def spans(df: DataFrame, text: str = "text", to: str = "spans", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Adds ``to``: an array of (start, kind number, end, kind, text, score), sorted; starts from 0, ends exclusive.

    A span's context is up to CONTEXT characters before it: its gap, and the span and gap before those where it is short."""
    kept = [c for c in df.columns if c != to]
    # all columns travel in one, so that none meets a name of this function
    rows = df.select(F.struct(*kept).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("whole"))
    own = {}
    for k in kinds:
        given = F.when(F.contains("whole", F.lit(k.hint)), F.col("whole")) if k.hint else F.col("whole")
        own[f"hits_{k.name}"] = F.regexp_extract_all(given, F.lit(k.pattern), F.lit(0))
        own[f"gaps_{k.name}"] = F.split(given, k.pattern, -1)
    rows = rows.withColumns(own)

    def placed(order: int, k: Kind) -> Column:
        hits, gaps = F.col(f"hits_{k.name}"), F.col(f"gaps_{k.name}")
        ends = running(F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda t, g: F.length(t) + F.length(g)), lambda a, b: a + b)
        found = F.arrays_zip(hits.alias("t"), F.slice(gaps, 1, F.size(hits)).alias("g"), ends.alias("e"))

        def scored(x: Column, old: Column) -> Column:
            near = F.lower(F.right(F.concat(F.coalesce(old["g"], F.lit("")), F.coalesce(old["t"], F.lit("")), x["g"]), F.lit(CONTEXT)))
            score = F.lit(k.sure) + F.when(near.rlike(k.near), BONUS).otherwise(0.0) - F.when(near.rlike(AGAINST), MALUS).otherwise(0.0)
            start = x["e"] - F.length(x["t"])
            return F.struct(start.alias("start"), F.lit(order).alias("order"), x["e"].alias("end"), F.lit(k.name).alias("kind"), x["t"].alias("text"), F.round(F.least(score, F.lit(1.0)), 2).alias("score"))

        made = let(found, lambda xs: F.transform(xs, lambda x, i: F.when(confirmed(k.name, x["t"]), scored(x, F.get(xs, i - 1)))))
        good = F.filter(made, lambda x: x.isNotNull() if k.base else x["score"] >= LEAST)
        return F.when(F.size(hits) > 0, good).otherwise(F.array().cast(SPANS))

    rows = rows.select("row", *(placed(i, k).alias(k.name) for i, k in enumerate(kinds)))
    return rows.select("row.*", F.array_sort(F.concat(*(F.col(k.name) for k in kinds))).alias(to))


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans and their scores in text form."""
    said = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    rows = spans(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", "spans")
    base = [k.name for k in KINDS if k.base]
    number = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    counts = [number(n).alias(f"n_{n}") for n in base]
    every = [F.array_join(F.transform("spans", said), ",").alias("spans"), F.array_join(F.transform("spans", lambda x: x["score"].cast("string")), ",").alias("scores")]
    return rows.select("doc_id", *counts, F.sha2(F.array_join(F.transform(F.filter("spans", lambda x: x["kind"].isin(base)), said), ","), 256).alias("base_sha256"), *every)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span of ``text`` replaced by its kind in brackets; of overlapping spans the first stands and the others' rests go with it. Null texts stay null."""
    marked = spans(df.select(F.struct(*df.columns).alias("all"), F.col(text).alias("text")))
    ends = running(F.transform("spans", lambda x: x["end"]), lambda a, b: F.greatest(a, b))  # how far the spans up to each one reach
    own = F.zip_with("spans", ends, lambda x, e: F.struct(x["start"], x["kind"], e.alias("reach")))
    own = let(own, lambda xs: F.transform(xs, lambda x, i: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["reach"].alias("reach"), F.coalesce(F.get(xs, i - 1)["reach"], F.lit(0)).alias("at"))))

    def block(b: Column) -> Column:
        low = F.get(b, F.lit(0))["at"]
        body = F.substring(F.col("text"), low + 1, F.get(b, F.size(b) - 1)["reach"] - low)
        part = lambda body, x: F.when(x["start"] >= x["at"], F.concat(F.substring(body, x["at"] - low + 1, x["start"] - x["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")
        return let(body, lambda y: F.array_join(F.transform(b, lambda x: part(y, x)), ""))

    top = F.array_max(ends)
    clean = F.concat(F.array_join(F.transform(in_blocks(F.col("own")), block), ""), F.substring(F.col("text"), top + 1, F.length("text") - top))
    marked = marked.withColumn("own", own)
    return marked.select("all", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")).alias("clean")).select(*(F.col("clean").alias(c) if c == text else F.col("all").getField(c).alias(c) for c in df.columns))
