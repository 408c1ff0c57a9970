"""Embedding near-dedup: subspace pigeonhole join.

Vectors are scaled to length one and turned by a fixed random rotation, which
spreads any difference over all coordinates.  cosine >= c means a squared distance
of at most 2 (1 - c).  The rotated coordinates are cut into BLOCKS subspaces, each
with a budget in proportion to its dimensions; two vectors within the whole
distance are within the budget of one subspace at least.  Each subspace is
range-joined: a grid over its first GRID coordinates, cells as wide as the
budget's diameter, an index entry in a vector's own cell and probes in that cell and
the later ones that its ball touches, so two cells meet from one side.  Within a cell
both sides are sorted by the next coordinate, and probes scan the stretch in reach.
The union of the candidates is verified by the cosine of the given vectors in double
precision; a pair counts in the first subspace whose budget it meets, so it counts
once.

Vectors of each length are joined among themselves.  A vector is divided by its
largest component before it is squared, so no finite size overflows or vanishes.
Equal vectors are one vector with a multiplicity.  A cell is split into pairs of
parts of at most PART vectors, so no task holds an unbounded cell; the plan of
parts depends on cell sizes, and there are at most as many cells as the grid has.
Tasks report each vector's number of partners and its component among the links that
they see.

Edge cases: null, empty and zero vectors and those with a null or non-finite component
link with nothing; equal vectors link with each other; each row is a vector of its own,
whatever ids it shares; a null id counts as a partner but names no component; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import connected_components, materialise, release, sized_broadcast

BLOCKS = 4
GRID = 3
PART = 4096
SLICE_BYTES = 1 << 30  # vectors that a slice may ship, where all of them have less than half of it
ROW_BYTES = 64  # of a shipped vector besides its numbers
SEED = 11
SLACK = 1e-5  # of squared distances in single precision; candidates are verified in double


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_slices(dim: int, blocks: int = BLOCKS) -> list[slice]:
    cuts = [dim * i // min(blocks, dim) for i in range(min(blocks, dim) + 1)]
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _rows(vectors: DataFrame) -> DataFrame:
    """row, vec_id and v: the vector (of its own precision) if it can link, else null."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.withColumn("v", F.when(F.col("v").isNotNull() & fine, F.col("v")))


def _cells(classes: DataFrame, cosine: float) -> DataFrame:
    """(dim, block, cell, probe, home, rep, size, v) for the own cell and the probed cells of every class in every block."""
    spread = 2 * (1 - cosine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = pa.compute.list_value_length(whole.column("v")).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                batch = whole.filter(pa.array(dims == dim))
                cuts = block_slices(dim)
                rotated = _unit(np.array(batch.column("v").to_pylist(), np.float64)) @ rotation(dim)
                for b, cut in enumerate(cuts):
                    own = rotated[:, cut][:, :GRID]
                    reach = np.sqrt(spread * (cut.stop - cut.start) / dim) + SLACK
                    low, high = np.floor((own - reach) / (2 * reach)).astype(np.int64), np.floor((own + reach) / (2 * reach)).astype(np.int64)
                    home = np.floor(own / (2 * reach)).astype(np.int64)
                    code = lambda g: ((g + 4096) * (8192 ** np.arange(g.shape[1]))).sum(axis=1)
                    at = code(home)
                    jobs = [(at, np.ones(len(own), bool), False)]
                    for corner in range(1 << own.shape[1]):
                        take = np.array([corner >> i & 1 for i in range(own.shape[1])], bool)
                        cell = code(np.where(take, high, low))
                        jobs.append((cell, ~((high == low) & take).any(axis=1) & (cell >= at), True))
                    for cell, live, probe in jobs:
                        rows = np.flatnonzero(live)
                        take = pa.array(rows)
                        fixed = [pa.array(np.full(len(rows), x)) for x in (np.int32(dim), np.int32(b))]
                        yield pa.RecordBatch.from_arrays([*fixed, pa.array(cell[rows]), pa.array(np.full(len(rows), probe)), pa.array((cell == at)[rows]), batch.column("rep").take(take), batch.column("size").take(take), batch.column("v").take(take)], names=["dim", "block", "cell", "probe", "home", "rep", "size", "v"])

    kind = classes.schema["v"].dataType.simpleString()
    return classes.select("rep", "size", "v").mapInArrow(run, f"dim int, block int, cell long, probe boolean, home boolean, rep long, size long, v {kind}")


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of the linked numbers a and b in label, where each number carries its component's smallest one."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def _counted(cosine: float):
    """Per part of a cell: (rep, partner rows, smallest rep of its component there) of every vector with a link."""

    def run(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        turn, cuts, spread = rotation(dim), block_slices(dim), 2 * (1 - cosine)
        block, probe = table["block"][0].as_py(), table["probe"].combine_chunks().to_numpy(zero_copy_only=False)
        home = table["home"].combine_chunks().to_numpy(zero_copy_only=False)
        rep, first, own = np.unique(table["rep"].to_numpy(), return_index=True, return_inverse=True)  # own: a row's number, in the order of rep
        size = table["size"].to_numpy()[first]
        raw = np.array(table["v"].combine_chunks().values.to_numpy(), np.float64).reshape(-1, dim)
        unit = _unit(raw)
        rotated = (unit @ turn).astype(np.float32)
        budget = [spread * (c.stop - c.start) / dim + SLACK for c in cuts]
        index, probes = np.flatnonzero(~probe), np.flatnonzero(probe)
        near = rotated[:, cuts[block]]
        line, reach = near[:, min(GRID, near.shape[1] - 1)], np.sqrt(budget[block]) + SLACK
        index, probes = index[np.argsort(line[index], kind="stable")], probes[np.argsort(line[probes], kind="stable")]
        norm = (near * near).sum(axis=1)
        partners, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for a in range(0, len(probes), 256):
            rows = probes[a : a + 256]
            ahead = index[np.searchsorted(line[index], line[rows[0]] - reach) : np.searchsorted(line[index], line[rows[-1]] + reach, side="right")]
            far = norm[rows][:, None] + norm[ahead][None, :] - 2 * near[rows] @ near[ahead].T
            i, j = np.nonzero(far <= budget[block])
            left, right = rows[i], ahead[j]
            keep = ~home[left] | (own[left] < own[right])  # within a cell a pair is met from both sides
            left, right = left[keep], right[keep]
            for c in range(0, len(left), 1 << 16):
                x, y = left[c : c + (1 << 16)], right[c : c + (1 << 16)]
                sure = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
                x, y = x[sure], y[sure]
                for e in range(block):  # met in an earlier subspace
                    d = rotated[x][:, cuts[e]] - rotated[y][:, cuts[e]]
                    late = (d * d).sum(axis=1) > budget[e]
                    x, y = x[late], y[late]
                p, q = own[x], own[y]
                np.add.at(partners, p, size[q])
                np.add.at(partners, q, size[p])
                _hook(label, p, q)
        met = partners > 0
        return pa.table({"rep": rep[met], "partners": partners[met], "other": rep[label[met]]})

    return run, "rep long, partners long, other long"


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, part: int = PART, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Parts of cells are worked off in slices, each of which ships slice_bytes or twice the vectors, whichever is more, so the disk in
    use grows with the vectors and not with the square of a cell's.
    """
    rows = materialise(_rows(vectors).withColumn("digest", F.xxhash64("v")), "vectors")
    classes = rows.where("v IS NOT NULL").groupBy("digest", "v").agg(F.min("row").alias("rep"), F.count("*").alias("size"), F.min("vec_id").alias("least"))
    classes = materialise(classes, "vector-classes")
    cells = _cells(classes, cosine)
    where = ["dim", "block", "cell"]
    counts = cells.groupBy(*where, "probe").count()
    shape = counts.groupBy(*where).agg(*[F.ceil(F.coalesce(F.max(F.when(F.col("probe") == p, F.col("count"))), F.lit(0)) / size).cast("int").alias(n) for p, n, size in ((False, "n_index", part), (True, "n_probe", 4 * part))], *[F.sum(F.when(F.col("probe") == p, F.col("count"))).alias(n) for p, n in ((False, "indexed"), (True, "probes"))])
    shape = materialise(shape.where("n_index > 0 AND n_probe > 0"), "vector-cells")
    live = sized_broadcast(shape, 64)
    width = 4 if "float" in classes.schema["v"].dataType.simpleString() else 8
    shipped = shape.agg(F.sum((F.col("indexed") * F.col("n_probe") + F.col("probes") * F.col("n_index")) * (width * F.col("dim") + ROW_BYTES))).first()[0] or 0
    held = classes.agg(F.sum(width * F.size("v") + ROW_BYTES)).first()[0] or 0
    slices = max(1, -(-shipped // max(slice_bytes, 2 * held)))
    own, other = F.expr("pmod(xxhash64(rep), if(probe, n_probe, n_index))"), F.expr("explode(sequence(0, if(probe, n_index, n_probe) - 1)) AS other")
    sized = cells.join(live, where).select("*", own.alias("own"), other)
    key = F.expr("xxhash64(dim, block, cell, if(probe, other, own), if(probe, own, other))")
    run, schema = _counted(cosine)
    sized = sized.select(key.alias("grp"), "dim", "block", "probe", "home", "rep", "size", "v")
    parts = []
    for i in range(slices):
        some = sized.where(f"pmod(grp, {slices}) = {i}") if slices > 1 else sized
        parts.append(materialise(some.groupBy("grp").applyInArrow(run, schema), "vector-links"))
        del some
        if slices > 1:
            release(vectors.sparkSession)
    found = reduce(DataFrame.unionByName, parts)
    partners = found.groupBy("rep").agg(F.sum("partners").alias("partners"))
    roots = connected_components(found.selectExpr("rep AS a", "other AS b")).withColumnsRenamed({"node": "rep"})
    known = classes.select("digest", "rep", F.col("v").alias("cv"), "size", "least").join(partners, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    known = materialise(known.selectExpr("digest", "cv", "root", "least", "size - 1 + coalesce(partners, 0) AS n_links"), "vector-known")
    names = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(names, "root").select(F.col("digest").alias("_digest"), "cv", "n_links", "component_id")
    out = rows.join(known, (rows["digest"] == known["_digest"]) & (rows["v"] == known["cv"]), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
