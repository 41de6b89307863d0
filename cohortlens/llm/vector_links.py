"""Near-duplicate vectors by cross-polytope hashing (Andoni et al. 2015).

A hash turns the unit vector by three rounds of random signs and a fast
Hadamard transform and takes the nearest signed axis; ``width`` such axes make
a bucket.  Every vector sits in its own bucket of each table and also probes
the buckets it would reach by its second-nearest axes (multiprobe).  A pair is
compared where at least one of the two is at home, and counted at its first
common bucket only, so sums need no list of pairs.

Vectors that are bit for bit equal are one class and compared once.  Large
buckets are cut into blocks of ``block`` members and compared block against
block, so a task holds few rows at a time and returns one row per linked member
of what it has read, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.components import connected_components
from cohortlens.llm.scratch import ship, stored

#: Least cosine of a link, hash tables, extra buckets probed a table, members of a block, seed of the rotations.
THRESHOLD, TABLES, PROBES, BLOCK, SEED = 0.98, 10, 1, 512, 20
#: Members up to which buckets are compared many at once, rows read before their buckets are compared.
SMALL, ROWS = 64, 8192


def _rotations(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice((-1.0, 1.0), (count, 3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised fast Walsh-Hadamard transform of each row; a power of two wide."""
    x, half = x.copy(), 1
    n, d = x.shape
    while half < d:
        pairs = x.reshape(n, d // (2 * half), 2, half)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), 2).reshape(n, d)
        half *= 2
    return x / np.sqrt(d)


def _axes(x: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest and second-nearest signed axis of each row and how much nearer the first is."""
    for s in signs:
        x = hadamard(x * s)
    size = np.abs(x)
    rows = np.arange(len(x))
    first = size.argmax(1)
    a = size[rows, first].copy()
    size[rows, first] = -1
    second = size.argmax(1)
    code = lambda i: 2 * i + (x[rows, i] < 0)
    return code(first), code(second), a - size[rows, second]


def bucket_codes(vectors: np.ndarray, tables: int, width: int, probes: int, seed: int) -> np.ndarray:
    """Bucket codes (rows, tables, 1 + probes): the home bucket, then the probed
    ones, the likeliest first.  Codes of different tables differ."""
    n, dim = vectors.shape
    d = 1 << max(1, int(dim - 1).bit_length())
    x = np.zeros((n, d))
    x[:, :dim] = vectors
    signs = _rotations(d, tables * width, seed)
    out = np.empty((n, tables, 1 + probes), np.int64)
    flips = np.array([[(c >> i) & 1 for i in range(width)] for c in range(1 << width)], bool)
    rows = np.arange(n)
    for t in range(tables):
        first, second, gap = (np.stack(v, 1) for v in zip(*(_axes(x, s) for s in signs[t * width : (t + 1) * width]), strict=True))
        cost = np.stack([gap[:, f].sum(1) for f in flips], 1)
        order = np.argsort(cost, 1, kind="stable")[:, : 1 + probes]
        for p in range(1 + probes):
            flip = flips[order[:, min(p, order.shape[1] - 1)]]
            axes = np.where(flip, second, first)
            code = np.zeros(n, np.int64)
            for i in range(width):
                code = code * (2 * d) + axes[:, i]
            out[rows, t, p] = code * tables + t
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    scale = np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _hashed(classes: DataFrame, width: int, tables: int, probes: int, seed: int) -> DataFrame:
    """``rep, label, size, vec, codes`` and one row per bucket of the class."""

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                vec = part.column("embedding")
                codes: list = [None] * part.num_rows
                dims = np.diff(vec.offsets.to_numpy())
                flat = vec.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(dims)
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    rows = np.stack([flat[ends[i] - dim : ends[i]] for i in at])
                    for i, c in zip(at.tolist(), bucket_codes(_unit(rows), tables, width, probes, seed), strict=True):
                        codes[i] = c.ravel()
                yield part.append_column("codes", pa.array(codes, pa.list_(pa.int64())))

    return classes.mapInArrow(hash_rows, "rep bigint, label int, size bigint, embedding array<double>, codes array<bigint>")


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """First common bucket, by table, of pairs given by their codes (pairs,
    tables, 1 + probes), of those where one of the two is at home."""
    none = np.iinfo(np.int64).max
    at_a = np.where((b == a[:, :, :1]).any(2), a[:, :, 0], none)
    at_b = np.where((a == b[:, :, :1]).any(2), b[:, :, 0], none)
    best = np.minimum(at_a, at_b)
    return best[np.arange(len(best)), (best != none).argmax(1)]


def _small_pairs(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the same run, for runs of a few rows."""
    for n in np.unique(size[size > 1]).tolist():
        at, (x, y) = start[size == n], np.triu_indices(n, 1)
        step = max(1, 50_000 // len(x))
        for lo in range(0, len(at), step):
            part = at[lo : lo + step, None]
            yield (part + x).ravel(), (part + y).ravel()


def _links(unit: np.ndarray, home: np.ndarray, block: np.ndarray, ij: np.ndarray, start: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of rows within the runs that begin at ``start``: of one
    block, or of two different ones."""
    size = np.diff(np.append(start, len(unit)))
    many = (size > SMALL) | (ij[start, 0] != ij[start, 1])
    for i, j in _small_pairs(start[~many], size[~many]):
        use = home[i] | home[j]
        i, j = i[use], j[use]
        near = (unit[i] * unit[j]).sum(1) >= threshold
        yield i[near], j[near]
    for at, n in zip(start[many].tolist(), size[many].tolist(), strict=True):
        rows = np.arange(at, at + n)
        x, y = (rows[block[rows] == b] for b in ij[at])
        cosine = unit[x] @ unit[y].T
        linked = cosine >= threshold
        # a product's last bits depend on the shape of its block: close calls are summed row by row
        p, q = np.nonzero(np.abs(cosine - threshold) < 1e-9)
        linked[p, q] = (unit[x[p]] * unit[y[q]]).sum(1) >= threshold
        p, q = np.nonzero(np.triu(linked, 1) if ij[at, 0] == ij[at, 1] else linked)
        use = home[x[p]] | home[y[q]]
        yield x[p][use], y[q][use]


def _padded(lists: pa.Array) -> np.ndarray:
    """A matrix of the lists, filled up with zeros (which leave cosines alone)."""
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(size), max(1, int(size.max(initial=0)))))
    out[np.arange(out.shape[1]) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _compare(threshold: float, tables: int):
    """Over rows sorted by bucket and blocks: ``rep, links`` (vectors linked here)
    and ``to`` (the smallest class it hangs on here), one row per linked class."""

    def of(t: pa.Table) -> pa.RecordBatch:
        key = np.stack([t.column(c).to_numpy() for c in ("label", "dim", "code", "i", "j")], 1)
        start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1))))
        code, rep, size = key[:, 2], t.column("rep").to_numpy(), t.column("size").to_numpy()
        codes = np.stack(t.column("codes").to_numpy()).reshape(len(rep), tables, -1)
        home = codes[np.arange(len(rep)), code % tables, 0] == code
        unit = _unit(_padded(t.column("embedding").combine_chunks()))
        found = [(np.zeros(0, np.int64),) * 2]
        for i, j in _links(unit, home, t.column("block").to_numpy(), key[:, 3:], start, threshold):
            own = _first_common(codes[i], codes[j]) == code[i] if len(i) else np.zeros(0, bool)
            found.append((i[own], j[own]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        names, inverse = np.unique(np.concatenate((rep[i], rep[j])), return_inverse=True)
        links = np.bincount(inverse, np.concatenate((size[j], size[i])), len(names)).astype(np.int64)
        up = list(range(len(names)))

        def root(v: int) -> int:
            while up[v] != v:
                up[v] = up[up[v]]
                v = up[v]
            return v

        for p, q in zip(inverse[: len(i)].tolist(), inverse[len(i) :].tolist(), strict=True):
            p, q = root(p), root(q)
            if p != q:
                up[max(p, q)] = min(p, q)
        to = names[[root(v) for v in range(len(names))]] if len(names) else names
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(links), pa.array(to)], names=["rep", "links", "to"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                held.append(batch.slice(lo, ROWS))
                if sum(b.num_rows for b in held) < ROWS:
                    continue
                t = pa.Table.from_batches(held).combine_chunks()
                key = np.stack([t.column(c).to_numpy() for c in ("label", "dim", "code", "i", "j")], 1)
                differs = np.flatnonzero((key != key[-1]).any(1))
                done = int(differs[-1]) + 1 if len(differs) else 0  # the last run may go on
                if done:
                    yield of(t.slice(0, done))
                held = t.slice(done).to_batches()
        if held:
            yield of(pa.Table.from_batches(held).combine_chunks())

    return compare


def link_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    tables: int = TABLES,
    probes: int = PROBES,
    block: int = BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links`` (other vectors with
    the same label and a cosine of ``threshold`` or more), ``component_id``
    (smallest id reachable by links, itself included), ``kept``.

    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows with a null label, link with nothing (0 links, their own
    component).  Vectors of different lengths never link.  Rows with a null id
    keep a null component and link with nothing.  Ids are expected to be unique:
    repeated rows count as links of each other.  An empty table gives no rows.
    """
    ship(vectors.sparkSession)
    e = F.col(embedding).cast("array<double>")
    big = F.aggregate(e, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = F.col(label).isNotNull() & F.col(vec_id).isNotNull() & e.isNotNull() & F.coalesce(fine, F.lit(False)) & (big > 0)
    read = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"),
        F.col(label).cast("int").alias("label"),
        F.when(ok, F.transform(e, lambda x: x + F.lit(0.0))).alias("embedding"),  # -0.0 becomes 0.0
    ).withColumn("same", F.when(F.col("embedding").isNotNull(), F.struct(F.xxhash64("label", "embedding"), F.xxhash64(F.lit(1), "label", "embedding"))))
    read = stored(read)
    valid = read.where("embedding IS NOT NULL")
    sizes = valid.groupBy("same").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    sizes = stored(sizes)
    classes = valid.select(F.col("vec_id").alias("rep"), "label", "embedding", "same").dropDuplicates(["rep"])
    classes = classes.join(sizes.select("rep", "size"), "rep").select("rep", "label", "size", "embedding")
    # enough axes that a bucket of unrelated vectors stays below one block
    top = sizes.join(valid.select(F.col("vec_id").alias("rep"), "label"), "rep").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    dim = valid.agg(F.max(F.size("embedding"))).first()[0] or 1
    axes = 2 << max(1, int(dim - 1).bit_length())
    width = 1
    while axes**width * block / 16 < top:
        width += 1
    hashed = stored(_hashed(classes, width, tables, probes, seed))

    # the distinct buckets of a class; a bucket counts if it is home to one member and has two
    code = F.explode(F.array_distinct("codes")).alias("code")
    homes = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.element_at("codes", (t * F.lit(1 + probes) + 1).cast("int")))
    spots = hashed.select("rep", "label", F.size("embedding").alias("dim"), code, homes.alias("homes"))
    spots = spots.select("rep", "label", "dim", "code", F.array_contains("homes", F.col("code")).cast("int").alias("home"))
    key = ["label", "dim", "code"]
    counted = spots.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("home")).where("n > 1 AND home = 1")
    spots = stored(spots.select("rep", *key).join(counted.select(*key, "n"), key))
    blocks = F.ceil(F.col("n") / block).cast("int")
    spots = spots.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    spots = spots.select("rep", *key, "block", other).select(
        "rep", *key, "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j")
    )
    full = spots.join(hashed.select("rep", "size", "embedding", "codes"), "rep")
    runs = full.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j")
    runs = runs.select("rep", "size", "embedding", "codes", "block", *[F.col(c).cast("bigint").alias(c) for c in (*key, "i", "j")])
    found = stored(runs.mapInArrow(_compare(threshold, tables), "rep bigint, links bigint, to bigint"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("rep").alias("a"), F.col("to").alias("b"))).withColumnRenamed("vertex", "rep")
    of_class = sizes.join(links, "rep", "left").join(comp, "rep", "left")
    of_class = of_class.select(
        "same", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")
    )
    out = read.select("vec_id", "same").join(of_class, "same", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))

