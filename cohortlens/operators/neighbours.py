"""Exact k nearest neighbours (Euclidean) as a Spark job.

Rows are dealt to the cells of a tree of cuts (the medians of a bounded sample) and,
in the order of the cells, cut into blocks of bounded size, so a dense spot is many
blocks and not one.  Up to ``MOST_SHELF`` neighbouring blocks are a shelf, which one task holds.
A first round finds every row's nearest within its shelf, block by block and only in
blocks whose bounding box is near enough.  That gives a distance within which its k
nearest must lie.  A row whose ball touches no bounding box of another shelf's blocks is
certified; the others are sent to the shelves with a block that theirs does touch, once
each, and what comes back is only what lies within that distance.  The result is that of comparing all pairs.

Visits are not stored: they are made once to be counted and once to be sent.  Tasks hold
one shelf and a bounded number of visitors; the tree and one box a block go to every task,
and both are bounded (``MOST_CELLS``, ``MOST_BLOCKS``: blocks hold more rows the more rows
there are).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import materialize
from cohortlens.sources.prepare import row_positions

#: Rows of a block, most blocks, visitors that a task compares with a shelf, per block of it.
BLOCK, MOST_BLOCKS, VISITORS = 512, 50_000, 4096
#: Shelves that rows are dealt to, as long as a shelf has no fewer and no more blocks than these.
SHELVES, LEAST_SHELF, MOST_SHELF = 48, 4, 128
#: Most cells of the tree, and rows of the sample per cell.
MOST_CELLS, SAMPLED = 4096, 16
_SLACK = 1e-9  # relative allowance for rounding: a block on the edge is visited


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    total = np.zeros((len(x), len(y)))
    for a, b in zip(x.T, y.T, strict=True):  # a column at a time: no third dimension in memory
        gap = a[:, None] - b
        gap *= gap
        total += gap
    return np.sqrt(total, out=total)


def _first_k(rows: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least ``d`` of each row, in order, ties by id."""
    order = np.lexsort((ids, d, rows))
    rows = rows[order]
    return order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]


def _nearest(ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k least of each row of ``d``, ties by id.  Only what is
    no farther than a row's k-th least is sorted."""
    if k < d.shape[1]:
        rows, cols = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
    else:
        rows, cols = (i.ravel() for i in np.indices(d.shape))
    best = _first_k(rows, ids[cols], d[rows, cols], k)
    rows, cols = rows[best], cols[best]
    there = np.isfinite(d[rows, cols])
    return rows[there], cols[there]


def _to_boxes(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least distance of each row to what lies in each box."""
    total = np.zeros((len(x), len(lo)))
    for a, low, high in zip(x.T, lo.T, hi.T, strict=True):
        gap = np.maximum(np.maximum(low - a[:, None], a[:, None] - high), 0)
        total += gap * gap
    return np.sqrt(total, out=total)


def _within(least: np.ndarray, far: np.ndarray) -> np.ndarray:
    return least <= far + _SLACK * (1 + np.abs(far))


class _Tree(NamedTuple):
    """Cuts: the column and value of each node, its two children (or -1 - cell), and of each cell the column it is spread along."""

    column: np.ndarray
    value: np.ndarray
    child: np.ndarray
    along: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.column) else np.full(len(x), -1)
        while (on := np.flatnonzero(at >= 0)).size:
            node = at[on]
            at[on] = self.child[node, (x[on, self.column[node]] > self.value[node]).astype(int)]
        return -1 - at


def _tree(sample: np.ndarray, cells: int) -> _Tree:
    """Cells of about equally many rows of the sample, neighbours side by side."""
    column, value, child, along = [], [], [], []
    todo = [(sample, cells, -1, 0)]
    while todo:
        rows, wanted, parent, side = todo.pop()
        spread = np.ptp(rows, axis=0)
        widest = int(spread.argmax())
        if wanted < 2 or not spread[widest] > 0:
            here = -1 - len(along)
            along.append(widest)
        else:
            here, v = len(column), np.sort(rows[:, widest])
            cut = v[(len(v) - 1) // 2]
            if cut == v[-1]:  # more than half have the largest value
                cut = v[v < cut][-1]
            left = rows[:, widest] <= cut
            share = min(max(round(wanted * left.mean()), 1), wanted - 1)
            column.append(widest)
            value.append(cut)
            child.append([0, 0])
            todo += [(rows[~left], wanted - share, here, 1), (rows[left], share, here, 0)]
        if parent >= 0:
            child[parent][side] = here
    return _Tree(np.array(column, int), np.array(value), np.array(child, int).reshape(-1, 2), np.array(along))


class _Search:
    """Nearest rows found so far of the rows ``x`` (``ids``), none farther than ``far``."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int):
        self.x, self.ids, self.far, self.k = x, ids, far.copy(), k
        self.best = np.full((len(x), k), np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def compare(self, some: np.ndarray, y: np.ndarray, ids: np.ndarray, same: int | None = None) -> None:
        """Compares the rows ``some`` with a block; ``same`` is where the block itself is among the rows.
        A product of matrices tells which are near enough, and these are measured exactly."""
        middle = y.mean(0)  # what is near it has small squares, which lose little
        there = y - middle
        square = (there * there).sum(1)
        for start in range(0, len(some), 1024):
            at = some[start : start + 1024]
            here = self.x[at] - middle
            length = (here * here).sum(1)
            d2 = length[:, None] + square - 2 * (here @ there.T)
            room = _SLACK * (length + square.max())
            if same is not None:
                d2[np.arange(len(at)), at - same] = np.inf
            limit = self.far[at] ** 2 * (1 + _SLACK) + room
            if len(y) > self.k and np.isinf(limit).any():
                limit = np.minimum(limit, np.partition(d2, self.k - 1, axis=1)[:, self.k - 1] + 2 * room)
            rows, cols = np.nonzero((d2 <= limit[:, None]) & np.isfinite(d2))
            d = np.zeros(len(rows))
            for a, b in zip(self.x[at].T, y.T, strict=True):
                d += (a[rows] - b[cols]) ** 2
            d = np.sqrt(d)
            near = _first_k(rows, ids[cols], d, self.k)
            near = near[d[near] <= self.far[at][rows[near]]]
            rows, cols, d = rows[near], cols[near], d[near]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            new = np.full((len(at), self.k), np.inf)
            new[rows, place] = d
            self.best[at] = np.sort(np.concatenate([self.best[at], new], axis=1), axis=1)[:, : self.k]
            self.far[at] = np.minimum(self.far[at], self.best[at][:, -1])
            self.found.append((at[rows], ids[cols], d))

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, their nearest rows' ids and distances."""
        if not self.found:
            return self.ids[:0], self.ids[:0], np.zeros(0)
        rows, ids, d = (np.concatenate(part) for part in zip(*self.found, strict=True))
        best = _first_k(rows, ids, d, self.k)
        return self.ids[rows[best]], ids[best], d[best]


def _vectors(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy()


def _parts(table: pa.Table, block: str, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Vectors and places in the table of the rows of each block."""
    names = table[block].to_numpy()
    order = np.argsort(names, kind="stable")
    x = _vectors(table["_x"], width)
    return [(x[at], at) for at in np.split(order, np.flatnonzero(np.diff(names[order])) + 1) if len(at)]


def _shelves(points: DataFrame, block: int) -> tuple[DataFrame, int]:
    """``_a, _x, _block, _shelf`` of each row, and the blocks of a shelf."""
    n = points.count()
    size = max(block, -(-n // MOST_BLOCKS))
    shelf = min(max(n // size // SHELVES, LEAST_SHELF), MOST_SHELF)
    cells = int(min(MOST_CELLS, max(1, n // size)))
    chosen = points.orderBy(F.xxhash64("_a")).limit(cells * SAMPLED).select("_x").collect()  # at most MOST_CELLS * SAMPLED rows
    tree = _tree(np.array([r["_x"] for r in chosen], dtype=float), cells)
    width = len(chosen[0]["_x"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(pa.chunked_array([batch["_x"]]), width)
            cell = tree.cells(x)
            r = x[np.arange(len(x)), tree.along[cell]]
            yield pa.RecordBatch.from_arrays([batch["_a"], batch["_x"], pa.array(cell, pa.int64()), pa.array(r, pa.float64())], ["_a", "_x", "_cell", "_r"])

    kind = points.schema["_a"].dataType.simpleString()
    dealt = materialize(points.mapInArrow(deal, f"_a {kind}, _x array<double>, _cell bigint, _r double"))
    placed = row_positions(dealt, ["_cell", "_r", "_a"], "_pos")
    first = placed.groupBy("_cell").agg(F.min("_pos").alias("_first"))  # a row a cell
    at = F.floor((F.col("_pos") - F.col("_first")) / size)
    placed = placed.join(F.broadcast(first), "_cell").withColumn("_at", at)
    block_no = F.col("_cell") * F.lit(1 << 32) + F.col("_at")
    shelf_no = F.floor((F.col("_first") - 1 + F.col("_at") * size) / (size * shelf))  # of the block's first row
    return materialize(placed.select("_a", "_x", block_no.alias("_block"), shelf_no.alias("_shelf"))), shelf


def nearest_neighbours(df: DataFrame, features: Sequence[str], id_col: str, k: int, block: int = BLOCK) -> DataFrame:
    """``_a, _b, dist, _j``: each row's k nearest other rows by the given columns
    (ties by id), j from 0; all others where there are fewer than k.  Ids must be
    unique and features present; an empty frame gives no rows."""
    found, _ = neighbours_and_work(df, features, id_col, k, block)
    return found


def neighbours_and_work(df: DataFrame, features: Sequence[str], id_col: str, k: int, block: int = BLOCK) -> tuple[DataFrame, dict]:
    """``nearest_neighbours`` and its work: rows, blocks, rows that are certified
    after the first round, and visits of the others to shelves."""
    vector = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    kind, width = df.schema[id_col].dataType.simpleString(), len(features)
    out = f"_a {kind}, _b {kind}, dist double"
    points = materialize(df.select(F.col(id_col).alias("_a"), vector.alias("_x")))
    if not points.limit(1).count():
        return points.sparkSession.createDataFrame([], out + ", _j int"), {"rows": 0, "blocks": 0, "certified": 0, "visits": 0}
    dealt, shelf = _shelves(points, block)

    def own(table: pa.Table) -> pa.Table:
        """The rows of a shelf with their nearest in it, and how far to look elsewhere."""
        parts = _parts(table, "_block", width)
        ids = _ids(table["_a"])
        lo, hi = np.array([x.min(0) for x, _ in parts]), np.array([x.max(0) for x, _ in parts])
        done = []
        for mine, (x, at) in enumerate(parts):
            search = _Search(x, ids[at], np.full(len(x), np.inf), k)
            search.compare(np.arange(len(x)), x, ids[at], same=0)
            least = _to_boxes(x, lo, hi)
            for other in np.argsort(least.mean(0), kind="stable"):
                if other != mine:
                    search.compare(np.flatnonzero(_within(least[:, other], search.far)), parts[other][0], ids[parts[other][1]])
            rows, near, d = (np.concatenate(part) for part in zip(*search.found, strict=True))
            best = _first_k(rows, near, d, k)
            ends = np.searchsorted(rows[best], np.arange(len(x) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v[best])) for v in (near, d)]
            done.append((at, lists, search.far))
        at = pa.array(np.concatenate([x[0] for x in done]))
        columns = [table["_a"].take(at), table["_x"].take(at), table["_shelf"].take(at)]
        columns += [pa.chunked_array([x[1][i] for x in done]) for i in (0, 1)] + [pa.array(np.concatenate([x[2] for x in done]))]
        return pa.Table.from_arrays(columns, ["_a", "_x", "_shelf", "_bs", "_ds", "_far"])

    held = f"_a {kind}, _x array<double>, _shelf bigint, _bs array<{kind}>, _ds array<double>, _far double"
    first = materialize(dealt.groupBy("_shelf").applyInArrow(own, held))
    boxes = [F.array(*[f(F.col("_x")[i]) for i in range(width)]).alias(n) for n, f in (("lo", F.min), ("hi", F.max))]
    grouped = dealt.groupBy("_shelf", "_block").agg(*boxes, F.count(F.lit(1)).alias("rows"))
    table = grouped.orderBy("_shelf", "_block").collect()  # MOST_BLOCKS + MOST_CELLS rows at most
    lo, hi = np.array([r["lo"] for r in table]), np.array([r["hi"] for r in table])
    names, starts = np.unique([r["_shelf"] for r in table], return_index=True)
    shelf_lo, shelf_hi = np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts)
    ends = np.append(starts[1:], len(table))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, fars, mine = _vectors(pa.chunked_array([batch["_x"]]), width), batch["_far"].to_numpy(), batch["_shelf"].to_numpy()
            for at in range(0, len(vectors), 1024):
                x, far = vectors[at : at + 1024], fars[at : at + 1024]
                near = _within(_to_boxes(x, shelf_lo, shelf_hi), far[:, None]) & (names != mine[at : at + 1024, None])
                for s in np.flatnonzero(near.any(0)):  # near the shelf's box: near one of its blocks' too?
                    some, blocks = np.flatnonzero(near[:, s]), slice(starts[s], ends[s])
                    near[some, s] = _within(_to_boxes(x[some], lo[blocks], hi[blocks]).min(1), far[some])
                i, j = np.nonzero(np.column_stack([near, ~near.any(1)]))  # the last column: no visit
                rows, where = pa.array(at + i), pa.array(np.append(names, -1)[j], mask=j == len(names))
                yield pa.RecordBatch.from_arrays([*(batch[c].take(rows) for c in ("_a", "_x", "_far")), where], ["_a", "_x", "_far", "_to"])

    # a row a visit, and one of no shelf for a row without
    visits = first.select("_a", "_x", "_far", "_shelf").mapInArrow(visit, f"_a {kind}, _x array<double>, _far double, _to bigint")
    shares = materialize(visits.groupBy("_to").agg(F.count(F.lit(1)).alias("_n")))  # a row a shelf
    made, certified = shares.agg(F.sum(F.when(F.col("_to").isNotNull(), F.col("_n"))), F.sum(F.when(F.col("_to").isNull(), F.col("_n")))).first()
    shares = shares.where("_to IS NOT NULL").select("_to", F.ceil(F.col("_n") / (VISITORS * shelf)).cast("int").alias("_shares"))
    guests = visits.join(F.broadcast(shares), "_to")
    guests = guests.select("_a", "_x", "_far", "_to", F.pmod(F.xxhash64("_a"), F.col("_shares")).alias("_share"))
    hosts = dealt.join(F.broadcast(shares.toDF("_at", "_of")), F.col("_shelf") == F.col("_at"))
    part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_of") - F.lit(1).cast("bigint")))
    hosts = hosts.select("_a", "_x", "_block", "_at", part.alias("_part"))

    def compare(here: pa.Table, there: pa.Table) -> pa.Table:
        ends = [np.zeros(0)] * 3
        if len(here) and len(there):
            parts, ids = _parts(there, "_block", width), _ids(there["_a"])
            lo, hi = np.array([x.min(0) for x, _ in parts]), np.array([x.max(0) for x, _ in parts])
            search = _Search(_vectors(here["_x"], width), _ids(here["_a"]), here["_far"].to_numpy(), k)
            for j, (y, at) in enumerate(parts):
                least = _to_boxes(search.x, lo[j : j + 1], hi[j : j + 1])[:, 0]
                search.compare(np.flatnonzero(_within(least, search.far)), y, ids[at])
            ends = search.result()
        types = [here.schema.field("_a").type] * 2 + [pa.float64()]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(ends, types, strict=True)], ["_a", "_b", "dist"])

    more = guests.groupBy("_to", "_share").cogroup(hosts.groupBy("_at", "_part")).applyInArrow(compare, out)
    here = first.select("_a", F.explode(F.arrays_zip(F.col("_bs").alias("_b"), F.col("_ds").alias("dist"))).alias("_p"))
    pairs = here.select("_a", F.col("_p._b").alias("_b"), F.col("_p.dist").alias("dist")).unionByName(more)
    # k of each row by aggregation: a visitor has at most k of every shelf
    best = F.slice(F.sort_array(F.collect_list(F.struct("dist", "_b"))), 1, k)
    chosen = pairs.groupBy("_a").agg(best.alias("_best")).select("_a", F.posexplode("_best").alias("_j", "_p"))
    work = {"rows": sum(r["rows"] for r in table), "blocks": len(table), "certified": certified or 0, "visits": made or 0}
    return chosen.select("_a", F.col("_p._b").alias("_b"), F.col("_p.dist").alias("dist"), "_j"), work
