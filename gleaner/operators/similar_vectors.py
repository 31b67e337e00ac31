"""Exact cosine join of two vector tables over a two-level tree of cells.

Unit vectors within angle ``theta`` of each other lie at nearly the same
angle from any third vector. The right table is sampled for centres, sixteen a
tile, so cells grow in number with the data and not in size; the first of them,
about the square root of their number, are the upper level. A right row goes to
the nearest upper centre and there to the nearest cell. A left row goes down
only where the radius of an upper centre, then of a cell, comes within ``theta``
of it: clustered data skips most cells and no pair is missed. Neighbouring small
cells share a tile, so a row is sent once per tile and not once per cell; large
cells are cut into several, and so are their visitors. A tile is multiplied
slice by slice, so that its memory depends neither on the rows of the tables nor
on the pairs found.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.vectors import stacked
from gleaner.session import checkpointed

SLACK = 1e-6  # angles come from rounded cosines
TREE_BYTES = 64 << 20  # of centres that every task gets; beyond it cells hold more tiles each
TILE_ROWS = 16_384  # of one side of a tile
TILE_CELLS = 16  # cells per tile where rows are spread evenly
SLICE = 1 << 21  # products, row-cell angles or vector components held at once
HOMES = 1_024  # rows placed in the tree at once
TILE = ["cell", "home", "guest"]


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1.0, norms)


def _angles(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(vectors) @ centres.T, -1.0, 1.0))


@dataclass
class CellTree:
    centres: np.ndarray  # of the cells; the first ones are the upper level too
    under: list[np.ndarray]  # cells below each upper centre

    @classmethod
    def over(cls, vectors: np.ndarray) -> CellTree:
        centres = _unit(np.asarray(vectors, dtype=np.float64))
        upper = math.ceil(math.sqrt(len(centres)))
        nearest = _angles(centres, centres[:upper]).argmin(axis=1)
        nearest[:upper] = np.arange(upper)
        return cls(centres, [np.flatnonzero(nearest == u) for u in range(upper)])

    def homes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each vector and its angle to the centre."""
        upper = _angles(vectors, self.centres[: len(self.under)]).argmin(axis=1)
        cell, angle = np.empty(len(vectors), np.int64), np.empty(len(vectors))
        for u in np.unique(upper):
            own = np.flatnonzero(upper == u)
            down = _angles(vectors[own], self.centres[self.under[u]])
            best = down.argmin(axis=1)
            cell[own], angle[own] = self.under[u][best], down[np.arange(len(own)), best]
        return cell, angle

    def upper_radius(self, radius: np.ndarray) -> np.ndarray:
        """How far from each upper centre the rows of its cells may be."""
        out = np.full(len(self.under), -10.0)
        for u, cells in enumerate(self.under):
            held = cells[radius[cells] >= 0]
            if len(held):
                out[u] = (_angles(self.centres[held], self.centres[u : u + 1])[:, 0] + radius[held]).max()
        return out

    def visits(self, vectors: np.ndarray, radius: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the cells that may hold a vector within ``theta`` of them."""
        near = _angles(vectors, self.centres[: len(self.under)]) - self.upper_radius(radius) <= theta + 2 * SLACK
        rows, cells = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for u in np.flatnonzero(near.any(axis=0)):
            own = np.flatnonzero(near[:, u])
            row, at = np.nonzero(_angles(vectors[own], self.centres[self.under[u]]) - radius[self.under[u]] <= theta + SLACK)
            rows.append(own[row])
            cells.append(self.under[u][at])
        return np.concatenate(rows), np.concatenate(cells)


def cell_tree(vectors: DataFrame, tile_rows: int) -> CellTree | None:
    """A tree over a sample of ``vectors(rid, vec)``; null when there is none."""
    facts = vectors.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    if not facts["n"]:
        return None
    cells = min(-(-TILE_CELLS * facts["n"] // tile_rows), TREE_BYTES // (8 * max(1, facts["d"])))
    chosen = vectors.orderBy(F.xxhash64("rid"), "rid").limit(max(1, cells)).select("vec").toPandas()
    return CellTree.over(stacked(chosen["vec"]))


def _floats(rows: DataFrame) -> DataFrame:
    """Rows that have a vector, which is an array of floats."""
    return rows.filter("vec IS NOT NULL").withColumn("vec", F.col("vec").cast("array<float>"))


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = flat.reshape(len(vectors), -1)
    if out.size and (np.diff(vectors.offsets.to_numpy()) != out.shape[1]).any():
        raise ValueError("vectors of one table must have one length")
    return out


def _in_cells(rows: DataFrame, tree) -> DataFrame:
    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, HOMES):
                part = batch.slice(at, HOMES)
                cell, angle = tree.value.homes(_matrix(part.column("vec")))
                columns = [*part.columns, pa.array(cell, pa.int32()), pa.array(angle)]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "cell", "angle"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(homes, f"{fields}, cell int, angle double")


def _shared_tiles(tree: CellTree, rows: np.ndarray, tile_rows: int) -> np.ndarray:
    """For each cell the first of the cells it shares a tile with: neighbours, up to ``tile_rows``."""
    first = np.arange(len(rows), dtype=np.int32)
    for cells in tree.under:
        lead, held = -1, 0
        for c in cells.tolist():
            if not rows[c]:
                continue
            if lead < 0 or held + rows[c] > tile_rows:
                lead, held = c, 0
            first[c] = lead
            held += rows[c]
    return first


def tiled(
    left: DataFrame, right: DataFrame, threshold: float, tile_rows: int
) -> tuple[DataFrame, DataFrame] | None:
    """Both tables with the tiles ``(cell, home, guest)`` that their rows meet in."""
    spark = left.sparkSession
    left, right = _floats(left.select("lid", "vec")), _floats(right.select("rid", "vec"))
    grown = cell_tree(right, tile_rows)
    if grown is None:
        return None
    tree = spark.sparkContext.broadcast(grown)
    theta = math.acos(min(1.0, max(-1.0, threshold)))
    placed = checkpointed(_in_cells(right, tree))
    # one row a cell, as many as the tree has centres
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r")).toPandas()
    radius = np.full(len(grown.centres), -10.0)  # an empty cell is never near
    radius[stats["cell"]] = stats["r"]
    held = np.zeros(len(radius), np.int64)
    held[stats["cell"]] = stats["n"]
    lead = _shared_tiles(grown, held, tile_rows)
    near = spark.sparkContext.broadcast((radius, lead))

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Slices of the batches, their rows, and the leading cell of each tile a row visits."""
        radius, lead = near.value
        step = max(1, SLICE // len(lead))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                row, cell = tree.value.visits(_matrix(part.column("vec")), radius, theta)
                both = np.unique(row * len(lead) + lead[cell])
                yield part, both // len(lead), both % len(lead)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, cell in visited(batches):
            cells, n = np.unique(cell, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(n)], names=["cell", "n"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, row, cell in visited(batches):
            # a row may visit every tile: its vector is repeated a few at a time
            step = max(1, SLICE // max(1, len(part.column("vec").flatten()) // part.num_rows))
            for at in range(0, len(row), step):
                rows = part.take(pa.array(row[at : at + step]))
                cells = pa.array(cell[at : at + step], pa.int32())
                yield pa.RecordBatch.from_arrays([*rows.columns, cells], names=["lid", "vec", "cell"])

    kind = left.schema["lid"].dataType.simpleString()
    leads = spark.createDataFrame([(int(c), int(lead[c])) for c in stats["cell"]], "cell int, lead int")
    guests = left.mapInArrow(counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("visitors"))
    # a row a tile: as many at most as the tree has centres
    tiles = F.broadcast(
        checkpointed(
            placed.groupBy("cell").count().join(F.broadcast(leads), "cell").groupBy(F.col("lead").alias("cell"))
            .agg(F.sum("count").alias("rows"))
            .join(guests, "cell")
            .select(
                "cell",
                F.ceil(F.col("rows") / tile_rows).cast("int").alias("homes"),
                F.ceil(F.col("visitors") / tile_rows).cast("int").alias("guests"),
            )
        )
    )
    rows_r = (
        placed.join(F.broadcast(leads), "cell").select("rid", "vec", F.col("lead").alias("cell")).join(tiles, "cell")
    ).select(
        "rid", "vec", "cell",
        F.pmod(F.xxhash64("rid"), F.col("homes")).cast("int").alias("home"),
        F.explode(F.sequence(F.lit(0), F.col("guests") - 1)).alias("guest"),
    )
    rows_l = left.mapInArrow(visits, f"lid {kind}, vec array<float>, cell int").join(tiles, "cell").select(
        "lid", "vec", "cell",
        F.explode(F.sequence(F.lit(0), F.col("homes") - 1)).alias("home"),
        F.pmod(F.xxhash64("lid"), F.col("guests")).cast("int").alias("guest"),
    )
    return rows_l, rows_r


def _best_of_rows(score: np.ndarray, threshold: float, best: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``best`` scores of each row that reach the threshold; the first columns win ties."""
    i, j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for row in range(len(score)):
        at = np.flatnonzero(score[row] >= threshold)
        if len(at) > best:
            at = at[np.argsort(-score[row, at], kind="stable")[:best]]
        i.append(np.full(len(at), row))
        j.append(at)
    return np.concatenate(i), np.concatenate(j)


def _hits(a: np.ndarray, b: np.ndarray, threshold: float, wanted) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and scores that reach the threshold, a few at a time: found in
    single precision less its error, confirmed in double precision."""
    error = a.shape[1] * 2.0**-22 * np.linalg.norm(a, axis=1).max() * np.linalg.norm(b, axis=1).max()
    rows = max(1, SLICE // len(b))
    for at in range(0, len(a), rows):
        part = a[at : at + rows]
        i, j = np.nonzero(part @ b.T >= threshold - error)
        if wanted is not None:
            keep = wanted(i + at, j)
            i, j = i[keep], j[keep]
        full = part.astype(np.float64) @ b.astype(np.float64).T if 16 * len(i) > len(part) * len(b) else None
        step = max(1, SLICE // a.shape[1])
        for k in range(0, len(i), step):
            x, y = i[k : k + step], j[k : k + step]
            score = full[x, y] if full is not None else np.einsum(
                "ij,ij->i", part[x].astype(np.float64), b[y].astype(np.float64)
            )
            keep = score >= threshold
            yield x[keep] + at, y[keep], score[keep]


def _best_hits(a: np.ndarray, b: np.ndarray, threshold: float, best: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    b = b.astype(np.float64).T
    rows = max(1, SLICE // b.shape[1])
    for at in range(0, len(a), rows):
        score = a[at : at + rows].astype(np.float64) @ b
        i, j = _best_of_rows(score, threshold, best)
        yield i + at, j, score[i, j]


def cosine_pairs(
    left: DataFrame,
    right: DataFrame,
    threshold: float,
    tile_rows: int = TILE_ROWS,
    best: int | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Pairs ``(lid, rid, score)`` with cosine at or above the threshold.

    ``left(lid, vec)`` and ``right(rid, vec)`` hold unit vectors; rows without
    one meet nothing. With ``best`` a tile gives that many of the highest scores
    per left row at most, so a ranking of the result has to be cut once more.
    With ``ordered`` only pairs with ``lid < rid`` are made.
    """
    lid, rid = (t.schema[c].dataType.simpleString() for t, c in ((left, "lid"), (right, "rid")))
    result = f"lid {lid}, rid {rid}, score double"
    sides = tiled(left, right, threshold, tile_rows)
    if sides is None:
        return left.sparkSession.createDataFrame([], result)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        guest = rows["lid"].is_valid()
        guests, homes = (rows.filter(x).combine_chunks() for x in (guest, pc.invert(guest)))
        if not guests.num_rows or not homes.num_rows:
            return
        homes = homes.sort_by("rid")
        ids = [t[c].combine_chunks() for t, c in ((guests, "lid"), (homes, "rid"))]
        a, b = (_matrix(t["vec"].combine_chunks()) for t in (guests, homes))
        if best is not None:
            found = _best_hits(a, b, threshold, best)
        elif ordered:
            x, y = (i.to_numpy(zero_copy_only=False) for i in ids)
            found = _hits(a, b, threshold, lambda i, j: x[i] < y[j])
        else:
            found = _hits(a, b, threshold, None)
        for i, j, score in found:
            yield pa.RecordBatch.from_arrays(
                [ids[0].take(pa.array(i)), ids[1].take(pa.array(j)), pa.array(score)], names=["lid", "rid", "score"]
            )

    rows_l, rows_r = sides
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows_l.withColumn("rid", F.lit(None).cast(rid))
        .unionByName(rows_r.withColumn("lid", F.lit(None).cast(lid)))
        .select(*TILE, "lid", "rid", "vec")
        .repartition(parts, *TILE)
        .groupBy(*TILE)
        .applyInArrow(product, result)
    )


def leading_vectors(nodes: DataFrame, threshold: float, crowd: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """First node (by ``order``) of every close neighbourhood of ``crowd`` nodes or more.

    ``nodes(gid, order, vec)``. Nodes of a cell within half the angle of its
    centre are close to each other.
    """
    named = _floats(nodes.select(F.col("gid").alias("rid"), "order", "vec"))
    grown = cell_tree(named, tile_rows)
    if grown is None:
        return nodes.select("gid").limit(0)
    half = math.acos(min(1.0, max(-1.0, threshold))) / 2
    return (
        _in_cells(named, nodes.sparkSession.sparkContext.broadcast(grown))
        .filter(F.col("angle") <= half)
        .groupBy("cell")
        .agg(F.count("*").alias("n"), F.min_by("rid", "order").alias("gid"))
        .filter(F.col("n") >= crowd)
        .select("gid")
    )


def cosine_self_pairs(vectors: DataFrame, threshold: float, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Pairs ``(earlier, later, score)`` of ``vectors(gid, vec)``, each once."""
    pairs = cosine_pairs(
        vectors.withColumnRenamed("gid", "lid"),
        vectors.withColumnRenamed("gid", "rid"),
        threshold,
        tile_rows,
        ordered=True,
    )
    return pairs.select(F.col("lid").alias("earlier"), F.col("rid").alias("later"), "score")
