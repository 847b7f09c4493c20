"""Embedding near-duplicates: an exact metric range join over pivot cells.

On unit vectors a cosine of c is a distance e = sqrt(2 - 2c). Each vector belongs to the cell of its nearest pivot. If y of p's cell
is within e of x, the triangle inequality gives d(x, p) <= radius(p) + e, where no vector of the cell is farther from p than its
radius, and d(x, p) <= d(x, own pivot) + 2e; as distances are Euclidean, x is also within e of the plane between both pivots:
d(x, p)^2 - d(x, own)^2 <= 2 e d(p, own). A vector is copied to just the cells for which all three hold and whose number is
below its own cell's, so every link is seen in one cell. Cells join independently, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .topk import finite

#: Vectors a cell should own, and cells of all labels together at most (their pivots are broadcast: about 32,768 vectors).
CELL_ROWS, MOST_PIVOTS = 2500, 32_768


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _columns(rows: pa.StructArray) -> list[np.ndarray]:
    """id, v (as a matrix), times and own of a block."""
    ids, v, times, own = rows.flatten()
    return [ids.to_numpy(), v.flatten().to_numpy().reshape(len(rows), -1), times.to_numpy(), own.to_numpy(zero_copy_only=False)]


def _by_name(batch: pa.RecordBatch, table: dict[str, np.ndarray]):
    """For each label of a batch (cell_of, id, v, times): its name, its rows, and their distances to the label's pivots."""
    names = batch.column(0).dictionary_encode()
    code = names.indices.to_numpy()
    for k, name in enumerate(names.dictionary.to_pylist()):
        at = np.flatnonzero(code == k)
        far = np.zeros((len(at), 1))
        if name in table:
            x = unit(batch.column(2).take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1))
            far = np.sqrt(np.maximum(0, 2 - 2 * x @ table[name].T))
        yield name, at, far


def _homes(table):
    def run(batches):
        for batch in batches:
            for name, _, far in _by_name(batch, table.value):
                if name in table.value:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(far)), pa.array(far.argmin(axis=1).astype(np.int32)), pa.array(far.min(axis=1))], ["name", "home", "far"])

    return run


def _copies(known):
    """Each vector in its own cell and in those earlier ones whose vectors may be within e of it."""

    def run(batches):
        table, radius, e = known.value
        for batch in batches:
            cell, of, own = [], [], []
            for name, at, far in _by_name(batch, table):
                home = far.argmin(axis=1)
                near = np.ones(far.shape, bool)
                if name in table:
                    between = np.sqrt(np.maximum(0, 2 - 2 * table[name] @ table[name].T))[home]
                    least = far.min(axis=1, keepdims=True)
                    near = (far <= radius[name] + e) & (far <= least + 2 * e) & (far * far - least * least <= 2 * e * between + 1e-6)
                    near &= np.arange(far.shape[1]) <= home[:, None]
                r, c = np.nonzero(near)
                of.append(at[r])
                own.append(home[r] == c)
                cell += [f"{name}:{k}" for k in c]
            of = pa.array(np.concatenate(of) if of else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.string()), pa.array(np.concatenate(own) if own else np.zeros(0, bool)), *(batch.column(k).take(of) for k in (1, 3, 2))], ["cell", "own", "id", "times", "v"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, block: int = 2048) -> DataFrame:
    """One row per row of vectors: vec_id, n_links (other vectors of its label with cosine >= threshold), component_id, kept.

    Vectors that are null, empty, zero or hold a null or non-finite component, and those without a label or an id, link with
    nothing and are their own component. Equal vectors of a label are joined as one class that counts as often as it occurs;
    vectors of different lengths aren't compared.
    """
    spark = vectors.sparkSession
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), vector.alias("v"))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("cell_of", F.when(usable, F.concat_ws(":", F.size("v"), "label"))).withColumn("k1", F.xxhash64(F.lit(1), "v")).withColumn("k2", F.xxhash64(F.lit(2), "v"))
    classes = rows.where("cell_of is not null").groupBy("cell_of", "k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("times"), F.first("v").alias("v"))
    classes = common.saved(classes, "classes")

    # pivots: of each label that needs more than one cell, about as many vectors, by a hash of the id
    sizes = classes.groupBy("cell_of").agg(F.count("*").alias("n"))
    each_cell = max(CELL_ROWS, classes.count() // MOST_PIVOTS)
    many = sizes.where(F.col("n") > each_cell)
    chosen = classes.join(common.small_side(many, many.count()), "cell_of").where(F.pmod(F.xxhash64(F.lit("pivot"), "id"), "n") < F.ceil(F.col("n") / each_cell) + 1)
    pivots: dict[str, list] = {}
    for row in chosen.select("cell_of", "v").orderBy("cell_of", F.xxhash64("id")).toLocalIterator():
        pivots.setdefault(row["cell_of"], []).append(row["v"])
    table = {k: unit(np.array(v)) for k, v in pivots.items()}
    homes = classes.select("cell_of", "id", "v", "times")
    radius: dict[str, np.ndarray] = {k: np.zeros(len(v)) for k, v in table.items()}
    for row in homes.mapInArrow(_homes(spark.sparkContext.broadcast(table)), "name string, home int, far double").groupBy("name", "home").agg(F.max("far").alias("far")).toLocalIterator():
        radius[row["name"]][row["home"]] = row["far"]
    known = spark.sparkContext.broadcast((table, radius, float(np.sqrt(2 - 2 * threshold)) + 1e-7))
    placed = homes.mapInArrow(_copies(known), "cell string, own boolean, id long, times long, v array<double>")
    shape = homes.mapInArrow(_copies(known), placed.schema).groupBy("cell").agg(F.ceil(F.count("*") / block).alias("visits"), F.ceil(F.count_if("own") / block).alias("owns"))
    shape = common.saved(shape, "shape")
    sized = placed.join(common.small_side(shape, shape.count()), "cell")
    struct = F.struct("id", "v", "times", "own")
    left = sized.where("own").groupBy("cell", F.pmod(F.xxhash64("id"), F.greatest("owns", F.lit(1))).alias("part"), "visits").agg(F.collect_list(struct).alias("mine"))
    left = left.select("cell", "mine", F.explode(F.expr("sequence(0L, visits - 1)")).alias("turn"))
    right = sized.groupBy("cell", F.pmod(F.xxhash64("id"), "visits").alias("turn")).agg(F.collect_list(struct).alias("all"))
    pairs = left.join(right.hint("shuffle_hash"), ["cell", "turn"]).select("mine", "all")

    def joined(batches):
        for batch in batches:
            for mine, other in zip(batch.column(0), batch.column(1), strict=True):
                (a, x, n, _), (b, y, m, own) = _columns(mine.values), _columns(other.values)
                r, c = np.nonzero(unit(x) @ unit(y).T >= threshold)
                apart = a[r] != b[c]
                r, c = r[apart], c[apart]
                links = np.bincount(r, m[c], len(a)).astype(np.int64)
                # a copy's links are counted here, too; two vectors of the cell see each other from both sides
                back = np.where(own, 0, np.bincount(c, n[r], len(b))).astype(np.int64)
                both = np.unique(np.concatenate([a[r], b[c]]))
                root = both[common.local_components(np.searchsorted(both, a[r]), np.searchsorted(both, b[c]), len(both))]
                some, more = np.flatnonzero(links), np.flatnonzero(back)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate([a[some], b[more], both]), np.concatenate([links[some], back[more], np.zeros(len(both), np.int64)]), np.concatenate([a[some], b[more], root]))], ["id", "links", "root"])

    found = common.saved(pairs.mapInArrow(joined, "id long, links long, root long"), "links")
    groups = common.components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    per_class = classes.drop("v").join(links, "id", "left").join(groups, F.col("id") == F.col("node"), "left")
    per_class = per_class.select("cell_of", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.drop("v").join(per_class, ["cell_of", "k1", "k2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
