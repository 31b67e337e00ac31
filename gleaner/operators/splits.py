"""Train / validation / test assignment."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.ranking import draw_cuts, seeded_draw

SPLITS = ("train", "val", "test")


def split_exact(
    pairs: DataFrame, key: str = "id", train: float = 0.8, val: float = 0.1, seed: int = 42
) -> DataFrame:
    """Add ``split`` with ``int(n * train)`` and ``int(n * val)`` rows, rest test.

    The order is a seeded hash of the key, so the same rows fall into the
    same split on every run; repeated rows of a key stay together, on the side
    of the first of them. Counting finds the two cuts: no row moves.
    """
    n = pairs.count()
    n_train, n_val = int(n * train), int(n * val)
    draw = seeded_draw(seed, F.col(key))
    places = [(0, "train", n_train), (0, "val", n_train + n_val)]
    cuts = draw_cuts(pairs.select(F.lit(0).alias("all"), draw.alias("draw")), places, "all", "draw")

    def before(name: str) -> Column:
        return draw < cuts[0, name][0] if (0, name) in cuts else F.lit(True)

    return pairs.withColumn(
        "split", F.when(before("train"), "train").when(before("val"), "val").otherwise("test")
    )


def split_by_hash(
    pairs: DataFrame, key: str = "id", train: float = 0.8, val: float = 0.1, seed: int = 42
) -> DataFrame:
    """Add ``split`` without any shuffle; sizes match the shares on average."""
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return pairs.withColumn(
        "split",
        F.when(draw < train, "train").when(draw < train + val, "val").otherwise("test"),
    )


def split_sizes(split: DataFrame) -> dict[str, int]:
    """Rows per split (three numbers)."""
    return {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
