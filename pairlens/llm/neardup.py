"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products in cells, one representative a group.

Of two vectors that link, x at home in cell c and y in cell c', the lead of x for c over c' and that of y for c' over c
add up to no more than the length of x - y times that of c - c'. So one of them is at most half of that, and the vector
that has it visits the other's cell: every pair meets in a cell, and most vectors visit few cells.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import connected_components, materialize, spanning
from .ngram_join import _grouped

#: Vectors of a cell on average, at least; most cells, rounds of k-means, rows of a block of products.
CELL, CELLS, ROUNDS, BLOCK = 64, 16_384, 5, 4096
_PART = 512


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    """Vectors of one width as rows in double precision."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([c.flatten().to_numpy().astype(np.float64).reshape(len(c), -1) for c in chunks])


def _sums(centres):
    def add(batches):
        c = centres.value
        total, many = np.zeros_like(c), np.zeros(len(c), np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, _PART):
                x = _unit(_matrix(batch["embedding"].slice(low, _PART)))
                near = (x @ c.T).argmax(axis=1)
                np.add.at(total, near, x)
                many += np.bincount(near, minlength=len(c))
        full = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(list(total[full]), pa.list_(pa.float64()))], ["cell", "total"])

    return add


def spherical_kmeans(vectors: DataFrame, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of ``cells`` (at most ``CELLS``) cells of vectors (vec_id, embedding); all rows count in each round.

    Centres begin at vectors drawn by a hash of vec_id. A round sends one sum for each cell and task, and
    the sums of all cells to the driver, as arrays.
    """
    spark = vectors.sparkSession
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(cells).select("embedding").toArrow()
    centres = _unit(_matrix(drawn["embedding"]))
    for _ in range(rounds if len(centres) > 1 else 0):
        shared = spark.sparkContext.broadcast(centres)
        parts = vectors.select("embedding").mapInArrow(_sums(shared), "cell long, total array<double>")
        width = centres.shape[1]
        total = parts.groupBy("cell").agg(F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total")).toArrow()
        if total.num_rows:
            cell, sums = total["cell"].to_numpy(), _matrix(total["total"])
            some = np.linalg.norm(sums, axis=1) > 0
            centres = centres.copy()
            centres[cell[some]] = _unit(sums[some])
        shared.unpersist()
    return centres


def _assigned(centres, least: float):
    """Each vector to its nearest cell, and as a visitor to the cells for which its lead is at most half a step's change.

    ``own`` is the vector's own cell; at home, ``also`` lists all cells that it is sent to.
    """
    half = np.sqrt(2 - 2 * least) / 2 + 1e-9

    def assign(batches):
        c = centres.value
        for batch in batches:
            for low in range(0, batch.num_rows, _PART):
                part = batch.slice(low, _PART)
                near = _unit(_matrix(part["embedding"])) @ c.T
                own = near.argmax(axis=1)
                gap = np.sqrt(np.maximum(0, 2 - 2 * c[own] @ c.T))
                row, cell = np.nonzero(near.max(axis=1)[:, None] - near <= half * gap + 1e-9)
                sent = np.split(cell.astype(np.int32), np.cumsum(np.bincount(row, minlength=len(own)))[:-1])
                also = [sent[r] if home else None for r, home in zip(row.tolist(), (own[row] == cell).tolist(), strict=True)]
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part["vec_id"].take(at), part["copies"].take(at), part["embedding"].take(at), pa.array(cell, pa.int64()), pa.array(own[row], pa.int64()), pa.array(also, pa.list_(pa.int32()))],
                    ["vec_id", "copies", "embedding", "cell", "own", "also"],
                )

    return assign


def _compared(least: float, cells: int):
    """Links of the vectors at home in a group with those that come to it, and edges that span the links.

    Of one cell, each vector at home counts its own links. A visitor's link counts for both ends, here or, where the
    other end is sent to the visitor's cell too, in the cell of the lower number.
    """

    def links(ids: np.ndarray, copies: np.ndarray):
        own, place = np.unique(ids, return_inverse=True)
        return own, np.bincount(place, copies).astype(np.int64)

    def compare(batches):
        for t in _grouped(batches, ["cell", "tile"]):
            ids, copies, visits, cell, tile, own = (t[c].to_numpy() for c in ("vec_id", "copies", "visits", "cell", "tile", "own"))
            x, also = _unit(_matrix(t["embedding"])), t["also"]
            edges = np.concatenate([[0], np.flatnonzero((cell[1:] != cell[:-1]) | (tile[1:] != tile[:-1])) + 1, [len(ids)]])
            for low, high in zip(edges, edges[1:], strict=False):
                at, here = np.arange(low, high), cell[low]
                rows, cols = at[visits[low:high] == 0], at[visits[low:high] == 1]
                for k in range(0, len(rows), 512):
                    r = rows[k : k + 512]
                    i, j = np.nonzero(x[r] @ x[cols].T >= least)
                    line, i, j = i, r[i], cols[j]
                    keep = ids[i] != ids[j]
                    away = own[j] != here
                    if away.any():
                        sent = np.zeros((len(r), cells), bool)
                        for n in np.unique(line[away]).tolist():
                            sent[n, also[int(r[n])].as_py()] = True
                        keep &= ~away | ~sent[line, own[j]] | (here < own[j])
                    i, j, away = i[keep], j[keep], away[keep]
                    if len(i):
                        found = [links(ids[i], copies[j]), links(ids[j[away]], copies[i[away]])]
                        a, b = spanning(ids[i], ids[j])
                        none = lambda v: np.zeros(len(v), np.int64)
                        columns = [np.concatenate(v) for v in ((*[f[0] for f in found], a), (*[none(f[0]) for f in found], b), (*[f[1] for f in found], none(a)))]
                        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], ["a", "b", "links"])

    return compare


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """Links of cosine ``least`` or more between embeddings (vec_id, embedding), and one representative a component.

    Cosines are in double precision. Equal vectors are compared once and counted as often as they are. Cells only
    choose which blocks to compare: of two vectors that link one visits the other's cell, so no link is lost. Cells grow
    in number with the root of the rows, to ``CELLS``. A vector that is null, empty or zero, or holds null or non-finite
    components, and a null vec_id, links with nothing; vectors of other widths than the most frequent one are compared
    among their width's. Large cells are cut into blocks. Rows come back one for one; other columns are ignored.
    Returns vec_id, n_links long, component_id long (smallest vec_id reached), kept boolean (vec_id = component_id).
    """
    spark = vectors.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("embedding")).alias("embedding"))
    element = vectors.schema["embedding"].dataType.elementType
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("embedding", F.when(sound, F.transform("embedding", lambda v: F.when(v == 0, F.lit(0).cast(element)).otherwise(v))))
    rows = materialize(rows.withColumn("vector", F.when(F.col("embedding").isNotNull(), F.sha2(F.to_json(F.struct("embedding")).cast("binary"), 256))))
    unique = rows.where("embedding IS NOT NULL").groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    unique = materialize(unique.withColumn("width", F.size("embedding")))
    found = None
    for w in unique.groupBy("width").count().orderBy("width").collect():
        part = unique.where(F.col("width") == w.width)
        centres = spherical_kmeans(part, min(CELLS, max(1, min(isqrt(w["count"]), w["count"] // CELL))))
        shared = spark.sparkContext.broadcast(centres)
        kind = dict(part.dtypes)["embedding"]
        dealt = part.select("vec_id", "copies", "embedding").mapInArrow(_assigned(shared, least), f"vec_id long, copies long, embedding {kind}, cell long, own long, also array<int>")
        home = F.col("own") == F.col("cell")
        sizes = materialize(dealt.groupBy("cell").agg(F.ceil(F.count_if(home) / BLOCK).alias("rows"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("columns")))
        dealt = dealt.join(F.broadcast(sizes), "cell").where("rows > 0")  # at most CELLS sizes
        upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        row, column = F.pmod(F.xxhash64("vec_id"), F.col("rows")), F.pmod(F.xxhash64("vec_id"), F.col("columns"))
        # As a visitor a vector meets every block of those at home; at home it meets every block of visitors.
        asked = F.transform(upto("rows"), lambda r: F.struct((r * F.col("columns") + column).alias("tile"), F.lit(1).alias("visits")))
        at_home = F.transform(upto("columns"), lambda c: F.struct((row * F.col("columns") + c).alias("tile"), F.lit(0).alias("visits")))
        dealt = dealt.withColumn("to", F.explode(F.concat(asked, F.when(home, at_home).otherwise(F.slice(at_home, 1, 0)))))
        dealt = dealt.select("cell", "to.tile", "to.visits", "vec_id", "copies", "own", F.when(F.col("to.visits") == 0, F.col("also")).alias("also"), "embedding")
        dealt = dealt.repartition(partitions, "cell", "tile").sortWithinPartitions("cell", "tile", "visits", "vec_id")
        got = dealt.mapInArrow(_compared(least, len(centres)), "a long, b long, links long")
        found = got if found is None else found.unionByName(got)
    if found is None:
        links, reached = spark.createDataFrame([], "a long, n long"), spark.createDataFrame([], "id long, component long")
    else:
        found = materialize(found)
        links = found.where("links > 0").groupBy("a").agg(F.sum("links").alias("n"))
        reached = connected_components(found.where("links = 0").select("a", "b"))
    named = unique.select("vector", "vec_id", "copies").join(links, F.col("vec_id") == F.col("a"), "left").join(reached, F.col("vec_id") == F.col("id"), "left")
    named = named.select(F.col("vector").alias("of"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    out = rows.select("vec_id", "vector").join(named, F.col("vector") == F.col("of"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
