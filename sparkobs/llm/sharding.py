"""Sharding along a Hilbert curve, in DataFrame functions alone.

Metadata dimensions are quantised to BITS bits each; rows are ordered by the curve's index over them (then by id) and
the order is cut into runs of equal row counts, so that a shard covers a small box of all dimensions and files prune
by any of them.

Defined results: null dimensions count as 0, the lowest cell; equal rows are interchangeable; fewer rows than shards
leave the last shards empty; empty tables give no rows; texts of any length count by their bytes; hot curve cells are
split by a hash of the id, so no task holds a cell whole; other columns are ignored by ``shard`` and kept by ``write``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkobs.llm.common import stored

BITS = 8
#: Rows of a range partition that is ranked by itself, and most partitions: the ranges' samples and sizes meet in one place, and a large range spills.
RUN_ROWS, RUNS = 20_000, 2000


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of cells with ``bits`` bits in each dimension (long; bits * dimensions < 63).

    Walks from the highest bit down with the entry point and the direction of the current subcube as its state:
    a subcube's corner number is read off in the rotated, reflected frame, its inverse Gray code is the next digit.
    """
    n = len(dims)
    top, full = 1 << n, (1 << n) - 1
    gray = [i ^ i >> 1 for i in range(top)]
    place = [gray.index(i) for i in range(top)]  # inverse Gray code
    enter = [0 if i == 0 else gray[2 * ((i - 1) // 2)] for i in range(top)]
    ones = lambda i: next(k for k in range(n + 1) if not i >> k & 1)  # noqa: E731  trailing ones
    turn = [0 if i == 0 else ones(i - 1 if i % 2 == 0 else i) % n for i in range(top)]

    def rotated(x: Column, by: Column) -> Column:
        """``x`` of n bits, rotated left by 0 to n - 1."""
        return F.call_function("shiftleft", x, by).bitwiseOR(F.call_function("shiftright", x, F.lit(n) - by)).bitwiseAND(full)

    look = lambda table, i: F.element_at(F.array(*map(F.lit, table)), i + 1)

    def step(state: Column, bit: Column) -> Column:
        corner = sum((F.call_function("shiftright", d.cast("int"), bit).bitwiseAND(1) * (1 << k) for k, d in enumerate(dims)), F.lit(0))
        back = F.pmod(F.lit(n) - F.pmod(state["d"] + 1, F.lit(n)), F.lit(n)).cast("int")  # rotating right by d + 1
        digit = look(place, rotated(corner.bitwiseXOR(state["e"]), back))
        return F.struct(
            (state["h"] * top + digit).alias("h"),
            state["e"].bitwiseXOR(rotated(look(enter, digit), F.pmod(state["d"] + 1, F.lit(n)).cast("int"))).alias("e"),
            F.pmod(state["d"] + look(turn, digit) + 1, F.lit(n)).cast("int").alias("d"),
        )

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda s: s["h"])


def cell_of_number(x: Column, bits: int = BITS) -> Column:
    """A non-negative number on a logarithmic scale: 8 cells for each doubling."""
    return F.coalesce(F.least(F.lit((1 << bits) - 1), F.floor(F.log2(F.greatest(x, F.lit(0)).cast("double") + 1) * 8)), F.lit(0)).cast("int")


def cell_of_text(x: Column, bits: int = BITS) -> Column:
    """A category: equal texts share a cell; 0 is kept for null."""
    return F.coalesce(F.pmod(F.xxhash64(x), F.lit((1 << bits) - 1)) + 1, F.lit(0)).cast("int") * x.isNotNull().cast("int")


def ranked(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with rank, gapless from 0 in ``order``, and their number. Ranges are sorted side by side; only their sizes meet."""
    rows = stored(rows, "rows")  # a few numbers a row; the range partitioner reads them twice, and no text again
    total = rows.count()
    parts = min(RUNS, max(1, -(-total // RUN_ROWS)))
    # An id's position within its range is read off the sorted range itself; the table fixes it for all later reads.
    own = stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id()), "ranges")
    own = own.withColumn("part", F.shiftright("m", 33)).withColumn("at", F.col("m").bitwiseAND((1 << 33) - 1))
    sizes = own.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row for each range
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return own.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("at")).drop("part", "at", "m", "before"), total


def shard(docs: DataFrame, dims: list[Column], shards: int, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """key, size, text_crc32, the curve's index, shard and slot: shards are runs of the curve, their counts at most one apart."""
    raw = F.col(text).cast("binary")
    rows = docs.select(F.col(key).cast("long").alias("id"), (F.coalesce(F.octet_length(raw), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(raw, F.lit(b""))).alias("crc"), *(d.alias(f"d{i}") for i, d in enumerate(dims)))
    rows = rows.withColumn("h", hilbert_index([F.col(f"d{i}") for i in range(len(dims))], bits)).select("id", "size", "crc", "h", F.xxhash64("id").alias("mix"))
    rows, total = ranked(rows, ["h", "mix", "id", "crc", "size"])
    own = F.expr(f"cast(rank * {shards} div {max(1, total)} as int)")
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")  # the least rank of the shard
    return rows.withColumn("shard", own).withColumn("slot", F.col("rank") - first).select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.col("h").alias("curve"), "shard", "slot")


def bounds(shards: DataFrame, dims: list[str]) -> DataFrame:
    """shard, rows, and the least and largest value of each dimension: what a reader needs to leave out whole shards."""
    return shards.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *(f(d).alias(f"{n}_{d}") for d in dims for n, f in (("least", F.min), ("most", F.max))))


def write(docs: DataFrame, dims: list[Column], shards: int, path: str, key: str = "doc_id", text: str = "text", bits: int = BITS) -> None:
    """All columns of ``docs`` as Parquet under ``path``, a folder for each shard, in the order of the curve: footers bound every dimension."""
    own = shard(docs, dims, shards, key, text, bits).select(F.col(key).alias("k"), "size", F.col("text_crc32").alias("crc"), "curve", "shard", "slot").dropDuplicates(["k", "size", "crc"])
    raw = F.col(text).cast("binary")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(key).cast("long").alias("k"), (F.coalesce(F.octet_length(raw), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(raw, F.lit(b""))).alias("crc"))
    placed = rows.join(own, rows.k.eqNullSafe(own.k) & (rows["size"] == own["size"]) & (rows.crc == own.crc))
    placed.select("doc.*", own.shard, own.slot).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
