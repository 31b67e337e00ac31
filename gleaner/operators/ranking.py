"""Total row order without funnelling all rows through one task."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import checkpointed

DIGITS = 3  # hexadecimal digits a counting round looks at: 4,096 buckets
BORDER = 20_000  # rows of a border bucket that may be ordered in one task
DRAW_DIGITS = 32  # of a whole draw

_SLOT_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def with_global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Add the zero-based position of each row in a total order.

    An unpartitioned window would sort everything in one task. Here rows are
    range-partitioned and sorted, and each position is the row's place in its
    partition plus the sizes of the partitions before it; only those sizes
    (one number per partition) visit the driver. ``order`` should end in a
    unique column so that equal keys can be spread.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn(name, F.monotonically_increasing_id())
    )
    slot = F.shiftright(name, _SLOT_BITS)
    sizes = placed.groupBy(slot.alias("slot")).count().collect()
    base, offsets = 0, []
    for row in sorted(sizes, key=lambda r: r["slot"]):
        offsets += [F.lit(row["slot"]), F.lit(base - (row["slot"] << _SLOT_BITS))]
        base += row["count"]
    if not offsets:
        return placed
    return placed.withColumn(name, F.col(name) + F.create_map(*offsets)[slot])


def with_running_total(df: DataFrame, value: str, *order: Column, name: str = "total") -> DataFrame:
    """Add the sum of ``value`` over all rows ahead of each row in a total order.

    As in ``with_global_rank`` one number per partition visits the driver;
    ``order`` should end in a unique column.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(
        df.repartitionByRange(parts, *order).withColumn("_slot", F.spark_partition_id())
    )
    totals = placed.groupBy("_slot").agg(F.sum(value).alias("n")).collect()
    base, offsets = 0, []
    for row in sorted(totals, key=lambda r: r["_slot"]):
        offsets += [F.lit(row["_slot"]), F.lit(base)]
        base += row["n"] or 0
    if not offsets:
        return placed.drop("_slot").withColumn(name, F.lit(0).cast("long"))
    ahead = Window.partitionBy("_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(ahead), F.lit(0))
    return placed.withColumn(name, inside + F.create_map(*offsets)[F.col("_slot")]).drop("_slot")


def with_group_rank(
    df: DataFrame, group: list[str], *order: Column, name: str = "rank"
) -> DataFrame:
    """Zero-based position of each row inside its group.

    Position in the total order by group, minus the group's first position, so
    a group holding a third of all rows is still spread over many tasks.
    """
    ranked = with_global_rank(df, *[F.col(g) for g in group], *order, name=name)
    first = ranked.groupBy(*group).agg(F.min(name).alias("_first"))
    same = reduce(
        lambda a, b: a & b, [F.col(f"r.{g}").eqNullSafe(F.col(f"f.{g}")) for g in group]
    )
    return (
        ranked.alias("r")
        .join(first.alias("f"), same)
        .select("r.*", "f._first")
        .withColumn(name, F.col(name) - F.col("_first"))
        .drop("_first")
    )


def first_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of a total order."""
    return df.orderBy(*order).limit(n)


def seeded_draw(seed: int, key: Column) -> Column:
    """Random place of a key as hexadecimal text: the same on every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def draw_cuts(
    rows: DataFrame, places: list[tuple], group: str, draw: str
) -> dict[tuple, tuple[str, int]]:
    """The draw at given places of each group's order, with the rows before it.

    ``rows(group, draw)`` hold a hexadecimal draw, ``places`` zero-based places
    ``(group, name, place)``, few enough to list. Returns ``(draw_at, before)``
    per ``(group, name)``: the ``before`` rows of the group with a smaller draw
    are its first ones. There is no entry where a group has no more rows than
    the place. Rows of equal draws lie on one side, the one of their first row.

    Nothing is sorted and no row moves: a round counts rows by the next few
    digits of their draw, keeps the one bucket the place falls into, and the
    next round looks into that bucket alone, a 4,096th of the rows. Only a
    bucket of at most ``BORDER`` rows is put in order. A round sends one row a
    place to the driver.
    """
    spark = rows.sparkSession
    kind = rows.schema[group].dataType.simpleString()
    schema = f"_group {kind}, name string, _left long, _before long, _prefix string"
    rows = rows.select(F.col(group).alias("_group"), F.col(draw).alias("_draw"))
    order = Window.partitionBy("_group", "name").orderBy("_key")

    def bucket(open_places: list[tuple], depth: int, digits: int) -> list:
        """The bucket each place falls into, buckets being the next ``digits``."""
        state = spark.createDataFrame(open_places, schema)
        same = F.col("r._group").eqNullSafe(F.col("s._group"))
        if depth:
            same = same & (F.substring("r._draw", 1, depth) == F.col("s._prefix"))
        return (
            rows.alias("r")
            .join(F.broadcast(state).alias("s"), same)
            .groupBy("s._group", "s.name", F.substring("r._draw", 1, depth + digits).alias("_key"))
            .agg(F.count("*").alias("n"), F.min("s._left").alias("left"), F.min("s._before").alias("before"))
            .withColumn("through", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .filter("through > left AND through - n <= left")
            .collect()
        )

    done, depth = {}, 0
    still = [(g, name, place, 0, "") for g, name, place in places]
    while still:
        found = bucket(still, depth, DIGITS)
        depth += DIGITS
        still, last = [], []
        for r in found:
            ahead = r["through"] - r["n"]
            entry = (r["_group"], r["name"], r["left"] - ahead, r["before"] + ahead, r["_key"])
            (last if r["n"] <= BORDER or len(r["_key"]) < depth else still).append(entry)
        if last:
            for r in bucket(last, depth, DRAW_DIGITS - depth):
                done[r["_group"], r["name"]] = (r["_key"], r["before"] + r["through"] - r["n"])
    return done
