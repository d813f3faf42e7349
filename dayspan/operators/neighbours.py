"""Exact k-nearest-neighbour classification without an all-pairs join.

Rows are assigned to the nearest of a few pivots. The triangle inequality gives a
radius per pivot cell that is sure to hold the k nearest training rows. Cells beside
each other form large groups of test rows, and a training row is sent once to each
group it can matter for. A task holds the test rows of a group and reads its training
rows one batch at a time, so what is written grows with the groups and not with the cells.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayspan.functions.columns import stable_hash

# Test rows of a group, which a task holds; test and training rows that are compared at once.
BLOCK_ROWS = 131_072
TILE_ROWS, BATCH_ROWS = 512, 2_048
LEAST_PIVOTS, MOST_PIVOTS = 8, 512
# A training row without a key comes after all others at the same distance.
NO_KEY = np.iinfo(np.int64).max


def _to_pivots(rows: DataFrame, key: str, pivots: np.ndarray, extra: str = "") -> DataFrame:
    """Add ``cell`` (nearest pivot) and ``reach`` (distance to it)."""

    def assign(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            d = _distances(np.stack(pdf["vec"].to_numpy()), pivots)
            yield pdf.assign(cell=d.argmin(axis=1).astype("int32"), reach=d.min(axis=1))

    return rows.mapInPandas(assign, f"id long, vec array<double>{extra}, cell int, reach double")


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.concatenate([np.sqrt(((x[i : i + 128, None, :] - pivots[None, :, :]) ** 2).sum(axis=2)) for i in range(0, len(x), 128)])


def _wanted(rows: DataFrame, pivots: np.ndarray, limit: np.ndarray, member: np.ndarray | None = None) -> DataFrame:
    """(id, vec, label, wanted): the groups with a cell whose limit the row's distance to the cell's pivot keeps; without ``member`` each cell is a group.

    The distances are computed again: a row of 512 of them is eight times its vector, too much to write.
    """

    def choose(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            near = _distances(np.stack(pdf["vec"].to_numpy()), pivots) <= limit * (1 + 1e-9)
            if member is not None:
                near = near.astype("float32") @ member > 0
            yield pdf.assign(wanted=[np.flatnonzero(r).astype("int32") for r in near])

    return rows.select("id", "vec", "label").mapInPandas(choose, "id long, vec array<double>, label long, wanted array<int>")


def _groups(pivots: np.ndarray, n_test: dict[int, int], n_train: int, tasks: int, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """First group and number of groups of each cell, all groups, and slices of a group's training rows.

    Training rows go to every group, test rows and their k neighbours to every slice: of the ways to keep ``tasks``
    tasks busy, the one that writes least. Cells are taken along the longest axis of the pivots.
    """
    total = sum(n_test.values())
    again = total * (1 + 5 * k / pivots.shape[1])
    few = max(1, -(-total // BLOCK_ROWS))
    most = min(range(few, max(few, tasks) + 1), key=lambda g: n_train * g + again * -(-tasks // g))
    room = -(-total // most)
    first, lots = np.zeros(len(pivots), int), np.ones(len(pivots), int)
    axis = np.linalg.svd(pivots - pivots.mean(axis=0), full_matrices=False)[2][0]
    group = filled = 0
    for cell in sorted(n_test, key=lambda c: (float(pivots[c] @ axis), c)):
        n = n_test[cell]
        if filled and (filled >= room or filled + n > BLOCK_ROWS):
            group, filled = group + 1, 0
        first[cell], lots[cell] = group, -(-n // BLOCK_ROWS)
        if lots[cell] > 1:
            group, filled = group + int(lots[cell]), 0
        else:
            filled += n
    groups = int(group) + int(filled > 0)
    return first, lots, groups, -(-tasks // groups)


class _Found:
    """The k nearest training rows so far of the test rows of a group; ties by train key."""

    def __init__(self, ids: pa.Array, x: np.ndarray, k: int):
        self.ids, self.x, self.square = ids, x, (x * x).sum(axis=1)
        self.d = np.full((len(x), k), np.inf)
        self.key, self.label, self.known = np.full((len(x), k), NO_KEY), np.zeros((len(x), k), np.int64), np.zeros((len(x), k), bool)
        self.n = np.zeros(len(x), np.int64)

    def meet(self, key: np.ndarray, label: np.ndarray, known: np.ndarray, y: np.ndarray) -> None:
        """Products tell which pairs can be among the nearest; only those are compared value by value."""
        k, square = self.d.shape[1], (y * y).sum(axis=1)
        for at in range(0, len(self.x), TILE_ROWS):
            here = slice(at, at + TILE_ROWS)
            score = self.x[here] @ (-2 * y).T
            score += square
            score += self.square[here, None]
            bound = self.d[here, -1] ** 2
            open_ = ~np.isfinite(bound)
            if open_.any() and len(y) >= k:
                bound[open_] = np.partition(score[open_], k - 1, axis=1)[:, k - 1]
            bound += 1e-11 * (self.square[here] + square.max() + np.where(np.isfinite(bound), bound, 0.0))
            i, j = np.nonzero(~(score > bound[:, None]))
            if not len(i):
                continue
            gap = self.x[here][i] - y[j]
            d = np.sqrt((gap * gap).sum(axis=1))
            # The rows that have found something, with what they had, in order; the first k of each stay.
            rows = np.unique(i)
            old = np.arange(k) < self.n[here][rows, None]
            own = np.concatenate([i, np.repeat(rows, old.sum(axis=1))])
            all_d = np.concatenate([d, self.d[here][rows][old]])
            all_key = np.concatenate([key[j], self.key[here][rows][old]])
            all_label = np.concatenate([label[j], self.label[here][rows][old]])
            all_known = np.concatenate([known[j], self.known[here][rows][old]])
            order = np.lexsort((all_key, all_d, own))
            own = own[order]
            place = np.arange(len(own)) - np.searchsorted(own, own)
            order, own, place = order[place < k], own[place < k], place[place < k]
            for into, values in ((self.d, all_d), (self.key, all_key), (self.label, all_label), (self.known, all_known)):
                into[at + own, place] = values[order]
            self.n[here] = np.maximum(self.n[here], np.bincount(own, minlength=len(score)))

    def rows(self) -> pa.RecordBatch:
        have = np.arange(self.d.shape[1]) < self.n[:, None]
        keys = self.key[have]
        return pa.RecordBatch.from_arrays(
            [
                self.ids.take(pa.array(np.nonzero(have)[0])),
                pa.array(keys, mask=keys == NO_KEY),
                pa.array(self.label[have], mask=~self.known[have]),
                pa.array(self.d[have]),
            ],
            names=["id", "train_id", "label", "d"],
        )


def nearest(train: DataFrame, test: DataFrame, key: str, cols: Sequence[str], label: str, k: int = 5, pivots: int | None = None) -> DataFrame:
    """(id, train_id, label, d): the k nearest training rows of every test row; ties by train key.

    Without ``pivots`` there are as many as the square root of the training rows, so cells and
    pivots grow together; between ``LEAST_PIVOTS`` and ``MOST_PIVOTS``, which bounds what goes to the tasks.
    Both tables are read several times and not written again: cut the lineage of a costly one.
    """
    vec = F.array(*[F.col(c).cast("double") for c in cols]).alias("vec")
    tr = train.na.drop("any", subset=list(cols)).select(F.col(key).cast("long").alias("id"), vec, F.col(label).cast("long").alias("label"))
    te = test.na.drop("any", subset=list(cols)).select(F.col(key).cast("long").alias("id"), vec)
    n_train = tr.count()
    if pivots is None:
        pivots = min(MOST_PIVOTS, max(LEAST_PIVOTS, int(n_train ** 0.5)))
    marks = np.array([r["vec"] for r in tr.orderBy(stable_hash(F.col("id"), 11), "id").limit(pivots).collect()])
    empty = "id long, train_id long, label long, d double"
    if len(marks) == 0:
        return train.sparkSession.createDataFrame([], empty)
    in_cells, te = _to_pivots(tr, key, marks, ", label long"), _to_pivots(te, key, marks)

    # Per train cell its k smallest reaches, per test cell its rows and largest reach: k x pivots numbers.
    first = Window.partitionBy("cell", "_part").orderBy("reach")
    inner = in_cells.select("cell", "reach", F.pmod(F.xxhash64("id"), F.lit(256)).alias("_part")).withColumn("_rn", F.row_number().over(first))
    close = inner.filter(F.col("_rn") <= k).groupBy("cell").agg(F.slice(F.array_sort(F.collect_list("reach")), 1, k).alias("r")).collect()
    cells = te.groupBy("cell").agg(F.max("reach").alias("u"), F.count(F.lit(1)).alias("n")).collect()
    if not cells:
        return train.sparkSession.createDataFrame([], empty)
    gaps = np.sqrt(np.maximum(0.0, ((marks[:, None, :] - marks[None, :, :]) ** 2).sum(axis=2)))
    radius = {}
    for cell, u in ((r["cell"], r["u"]) for r in cells):
        bounds = sorted(u + gaps[cell, r["cell"]] + x for r in close for x in r["r"])
        radius[cell] = (bounds[k - 1] if len(bounds) >= k else float("inf")) + u

    # A training row at distance a from pivot i can only matter to cell i if a <= radius(i).
    limit = np.array([radius.get(i, -1.0) for i in range(len(marks))])
    start, lots, groups, slices = _groups(marks, {r["cell"]: r["n"] for r in cells}, n_train, train.sparkSession.sparkContext.defaultParallelism, k)
    member = np.zeros((len(marks), groups), "float32")
    for cell in radius:
        member[cell, start[cell]:start[cell] + lots[cell]] = 1
    spread = F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 20))
    own = F.get(F.array(*[F.lit(int(g)) for g in start]), F.col("cell")) + spread % F.get(F.array(*[F.lit(int(n)) for n in lots]), F.col("cell"))
    left = te.select("id", "vec", F.lit(None).cast("long").alias("label"), F.lit(0).alias("side"), own.alias("group"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    sent = _wanted(tr, marks, limit, member).select("id", "vec", "label", F.lit(1).alias("side"), F.explode("wanted").alias("group"), (spread % slices).alias("slice"))
    task = (F.col("group") * slices + F.col("slice")).cast("int")
    dealt = left.unionByName(sent).select("id", "vec", "label", "side", task.alias("task")).repartitionById(groups * slices, F.col("task")).sortWithinPartitions("task", "side")
    wide = len(cols)

    def compare(batches):
        task, held, found = None, [], None
        for batch in batches:
            tasks, sides = batch.column("task").to_numpy(), batch.column("side").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(tasks) != 0) | (np.diff(sides) != 0)) + 1), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if tasks[a] != task:
                    if found is not None:
                        yield found.rows()
                    task, held, found = tasks[a], [], None
                part = batch.slice(a, b - a)
                x = part.column("vec").flatten().to_numpy().reshape(-1, wide)
                if sides[a] == 0:
                    held.append((part.column("id"), x.copy()))
                    continue
                if not held and found is None:
                    continue  # no test row is near
                if found is None:
                    found = _Found(pa.concat_arrays([i for i, _ in held]), np.concatenate([v for _, v in held]), k)
                    held = []
                keys, labels = pc.fill_null(part.column("id"), int(NO_KEY)).to_numpy(), part.column("label")
                known, labels = labels.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(labels, 0).to_numpy()
                for i in range(0, len(x), BATCH_ROWS):
                    j = slice(i, i + BATCH_ROWS)
                    found.meet(keys[j], labels[j], known[j], x[j])
        if found is not None:
            yield found.rows()

    rank = Window.partitionBy("id").orderBy("d", F.col("train_id").asc_nulls_last())
    return dealt.mapInArrow(compare, empty).withColumn("_rn", F.row_number().over(rank)).filter(F.col("_rn") <= k).drop("_rn")


def knn_classify(train: DataFrame, test: DataFrame, key: str, cols: Sequence[str], label: str, k: int = 5) -> DataFrame:
    """(key, prediction): majority label of the k nearest, the smaller label on a tie."""
    votes = nearest(train, test, key, cols, label, k).groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"))
    # Most votes first, then the smaller label.
    top = F.max_by("label", F.struct("n", (-F.col("label")).alias("low")))
    return votes.groupBy("id").agg(top.alias("prediction")).withColumnRenamed("id", key)
