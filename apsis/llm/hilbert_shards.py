"""Shards that are runs of a Hilbert curve through several metadata dimensions, so that a filter on any of them skips files.

Each dimension is cut into 2 ** bits levels of about as many rows each; the levels of a row are a cell of a grid, and the curve
visits every cell once, neighbours after neighbours. Rows are sorted by the curve's index and cut into runs.

Cases: a null is the lowest level of its dimension (and weighs nothing); ties in a cell follow the given columns, and rows that
tie there too, or are repeated, come in any order, over as many tasks as they need; very long texts never move unless the caller
keeps them; an empty table has no rows; columns of the result's names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .ordering import numbered

BITS, SHARDS = 5, 16


def _curve_tables(dims: int) -> tuple[list[int], list[int], list[int]]:
    """Of each cell of the 2 ** dims corners: its rank in the Gray code, and of each rank the corner where its part of the curve
    begins and the axis along which that part runs (Hamilton and Rau-Chaplin, "Compact Hilbert indices")."""
    corners = 1 << dims
    gray = [k ^ k >> 1 for k in range(corners)]
    rank = [gray.index(k) for k in range(corners)]
    entry = [0 if k == 0 else gray[2 * ((k - 1) // 2)] for k in range(corners)]
    ones = lambda k: (~k & k + 1).bit_length() - 1  # noqa: E731  trailing set bits
    axis = [0 if k == 0 else ones(k if k % 2 else k - 1) % dims for k in range(corners)]
    return rank, entry, axis


def hilbert_index(levels: list[Column], bits: int = BITS) -> Column:
    """The place of a cell on the curve. levels: integers from 0 to 2 ** bits - 1, one for each dimension (at least two)."""
    n = len(levels)
    if n < 2 or n * bits > 62:
        raise ValueError("a curve needs two dimensions or more, and at most 62 bits")
    rank, entry, axis = ([F.lit(x) for x in table] for table in _curve_tables(n))
    mask = (1 << n) - 1
    table = lambda t, k: F.element_at(F.array(*t), k + 1)
    power = lambda k: table([F.lit(1 << j) for j in range(n + 1)], k)
    # A turn by k bits is a division and a remainder by powers of two.
    left = lambda x, k: (x * power(k)).bitwiseAND(mask).bitwiseOR(F.floor(x / power(F.lit(n) - k)).cast("int"))
    right = lambda x, k: left(x, F.pmod(F.lit(n) - k, F.lit(n)))
    digits = F.array(*[sum((F.shiftright(c.cast("int"), b).bitwiseAND(1) * (1 << j) for j, c in enumerate(levels)), F.lit(0)) for b in range(bits - 1, -1, -1)])

    def step(s: Column, corner: Column) -> Column:
        turned = right(corner.bitwiseXOR(s["from"]), F.pmod(s["along"] + 1, F.lit(n)))
        at = F.struct(table(rank, turned).alias("w"))
        # A list of one, so that the rank is worked out once.
        return F.transform(
            F.array(at),
            lambda w: F.struct(
                s["from"].bitwiseXOR(left(table(entry, w["w"]), F.pmod(s["along"] + 1, F.lit(n)))).alias("from"),
                F.pmod(s["along"] + table(axis, w["w"]) + 1, F.lit(n)).alias("along"),
                (s["index"] * (1 << n) + w["w"]).alias("index"),
            ),
        )[0]

    start = F.struct(F.lit(0).alias("from"), F.lit(0).alias("along"), F.lit(0).cast("bigint").alias("index"))
    return F.aggregate(digits, start, step, lambda s: s["index"])


def level(rows: DataFrame, column: str, bits: int = BITS) -> Column:
    """The level of a column's values: floor(rows with a smaller value * 2 ** bits / rows). It is exact, however many values
    there are; only where levels begin, at most 2 ** bits values, comes to the driver."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    placed = numbered(counts, ["value"], weight="n")
    cuts = placed.groupBy(F.expr(f"cast(_before * {1 << bits} div _total as int)").alias("level")).agg(F.min("value").alias("value")).where("value is not null")
    found = F.lit(0)
    for cut in sorted(cuts.collect(), key=lambda r: r["level"]):
        found = F.when(F.col(column) >= F.lit(cut["value"]), cut["level"]).otherwise(found)
    return found


def shard(rows: DataFrame, dims: list[str], shards: int = SHARDS, law: str = "rows", weight: str | None = None, ties: tuple[str, ...] = (), bits: int = BITS) -> DataFrame:
    """rows with curve (their index), shard and slot (from 0 in each shard). law "rows": runs of equal length, at most one row
    apart; "weight": runs of about equal weight (a column of integers, null counts as none)."""
    if law not in ("rows", "weight") or (law == "weight") != (weight is not None):
        raise ValueError('law is "rows", or "weight" with a weight')
    kept = materialize(rows.drop("curve", "shard", "slot"), "shard-rows")
    levels = {f"_level{k}": level(kept, c, bits) for k, c in enumerate(dims)}
    curved = kept.withColumns(levels).withColumn("curve", hilbert_index([F.col(c) for c in levels], bits)).drop(*levels)
    if law == "rows":
        number = lambda at: F.expr(at).cast("int").alias("shard")
        placed = numbered(curved, ["curve", *ties])
        cut = placed.select(*curved.columns, "_position", "_size", number(f"_position * {shards} div _size"))
        return cut.select(*curved.columns, "shard", (F.col("_position") - F.expr(f"(shard * _size + {shards - 1}) div {shards}")).alias("slot"))
    placed = numbered(curved.withColumn("_weight", F.coalesce(F.col(weight), F.lit(0)).cast("bigint")), ["curve", *ties], weight="_weight")
    # The shard of a row is that of its middle; rows without any weight at all go to shard 0.
    cut = placed.withColumn("shard", F.coalesce(F.least(F.expr(f"(2 * _before + _weight) * {shards} div nullif(2 * _total, 0)"), F.lit(shards - 1)), F.lit(0)).cast("int"))
    first = cut.groupBy("shard").agg(F.min("_position").alias("_first"))  # a row a shard
    return cut.join(F.broadcast(first), "shard").select(*curved.columns, "shard", (F.col("_position") - F.col("_first")).alias("slot"))


def zone_map(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """Of each shard its number of rows and the least and greatest value of the columns, as a reader prunes by."""
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *[f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))])


def write_shards(sharded: DataFrame, path: str, tasks: int = 1) -> None:
    """Parquet, a folder a shard, rows in order; a shard is dealt by runs of slots over `tasks` tasks, and so files."""
    sized = sharded if tasks == 1 else sharded.withColumn("_run", F.expr(f"pmod(slot div 100000, {tasks})"))
    keys = ["shard"] if tasks == 1 else ["shard", "_run"]
    sized.repartition(*keys).sortWithinPartitions("shard", "slot").drop("_run").write.mode("overwrite").partitionBy("shard").parquet(path)
