"""Boosted trees over many rows: Spark's method (logistic loss, variance, 32 bins), with histograms made by numpy in tasks.

Inputs are put into bins once and packed, CHUNK rows to an item; an item also carries what the trees so far give for its rows.
A level of a tree is one pass: tasks count rows and add up slopes by node, input and bin, and only those sums meet.
The trees become a model of Spark ML, which scores, is saved and is read back as any other.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthspark.session import shared_dir, ship, use_checkpoints, written

# Rows of a packed item, items that one task takes alone, those of a task of many at most, and values that stand for all of an input.
CHUNK, ALONE, ITEMS, POINTS = 32_768, 16, 64, 1024


@dataclass
class Tree:
    """A tree of full depth, children of node i at 2 i + 1 and 2 i + 2; beyond a leaf all rows go left and keep its value."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    split: np.ndarray
    gain: np.ndarray
    stats: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        inner, nodes = 2**depth - 1, 2 ** (depth + 1) - 1
        return cls(
            np.zeros(inner, dtype=np.int64), np.full(inner, 255, dtype=np.uint8), np.zeros(nodes),
            np.zeros(inner, dtype=bool), np.zeros(inner), np.zeros((nodes, 3)),
        )

    def descend(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after so many levels, by its place from the left."""
        if not levels:
            return np.zeros(bins.shape[1], dtype=np.uint8)

        def below(at: int, left: int) -> np.ndarray:
            right = (bins[self.feature[at]] > self.cut[at]).view(np.uint8)
            if left == 1:
                return right
            here, there = below(2 * at + 1, left - 1), below(2 * at + 2, left - 1) | np.uint8(1 << (left - 1))
            return here ^ ((here ^ there) & -right)

        return below(0, levels)


# --- bins -------------------------------------------------------------------------

def _fewer(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their weights; of more than POINTS, the largest of each run of about equal weight. A value that weighs more is alone."""
    kept, at = np.unique(values, return_inverse=True)
    held = np.bincount(at, weights, minlength=len(kept))
    if len(kept) <= POINTS:
        return kept, held
    upto = np.cumsum(held)
    run = np.minimum(np.floor(upto / upto[-1] * POINTS), POINTS - 1)
    heavy = np.append(held * POINTS > upto[-1], True)
    last = np.flatnonzero(np.append(np.diff(run) > 0, True) | heavy[:-1] | heavy[1:])
    return kept[last], np.diff(np.concatenate([[0.0], upto[last]]))


def _checked(batch: pa.RecordBatch, inputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(inputs, label, weight): rows that the learner cannot read fail the job."""
    columns = [np.asarray(c.to_numpy(zero_copy_only=False), dtype=np.float64) for c in batch.columns]
    x, label = np.array(columns[:inputs]).reshape(inputs, -1), columns[inputs]
    if not (label == np.floor(label)).all() or not ((label == 0) | (label == 1)).all():
        raise ValueError("a label is missing or neither 0 nor 1")
    if np.isnan(x).any():
        raise ValueError("an input is missing or no number")
    return x, label, columns[inputs + 1] if len(columns) > inputs + 1 else None


def _points(train: DataFrame, inputs: int) -> DataFrame:
    """(feature, value, weight): values of each input that stand for all rows, as packed doubles, a row for each input."""
    kind = "feature int, value binary, weight binary"

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.empty(0), np.empty(0))] * inputs
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def add() -> None:
            x = np.concatenate([x for x, _ in waiting], axis=1)
            weight = np.concatenate([w for _, w in waiting])
            for k, (value, held) in enumerate(kept):
                kept[k] = _fewer(np.concatenate([value, x[k]]), np.concatenate([held, weight]))
            waiting.clear()

        for batch in batches:
            x, label, weight = _checked(batch, inputs)
            waiting.append((x, np.ones(len(label)) if weight is None else weight))
            if sum(len(w) for _, w in waiting) >= 1 << 18:
                add()
        if waiting:
            add()
            yield pa.RecordBatch.from_pylist(
                [{"feature": k, "value": v.tobytes(), "weight": w.tobytes()} for k, (v, w) in enumerate(kept)], schema=sketch
            )

    def merged(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b"".join(table[c].to_pylist())) for c in ("value", "weight")]
        value, weight = _fewer(*parts)
        return pa.Table.from_pylist([{"feature": table["feature"][0].as_py(), "value": value.tobytes(), "weight": weight.tobytes()}], schema=sketch)

    sketch = pa.schema([("feature", pa.int32()), ("value", pa.binary()), ("weight", pa.binary())])
    return train.mapInArrow(summed, kind).groupBy("feature").applyInArrow(merged, kind)


def cuts(value: np.ndarray, weight: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` places between the ascending values, each with about as many rows from the one before; all if they are few."""
    between = (value[1:] + value[:-1]) / 2
    if len(between) <= most:
        return between
    stride = weight.sum() / (most + 1)
    out, target, before = [], stride, weight[0]
    for k in range(1, len(value)):
        if len(out) == most:
            break
        if abs(before - target) < abs(before + weight[k] - target):
            out.append(between[k - 1])
            target += stride
        before += weight[k]
    return np.array(out)


def _packed(train: DataFrame, places: list[np.ndarray]) -> DataFrame:
    """Items of CHUNK rows: bins, labels of -1 and 1, weights (none if all are 1)."""
    inputs = len(places)

    def item(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]) -> pa.RecordBatch:
        x = np.concatenate([r[0] for r in rows], axis=1)
        bins = np.array([np.searchsorted(p, v, side="left") for p, v in zip(places, x, strict=True)], dtype=np.uint8)
        label = (2 * np.concatenate([r[1] for r in rows]) - 1).astype(np.int8)
        weight = None if rows[0][2] is None else np.concatenate([r[2] for r in rows]).tobytes()
        return pa.RecordBatch.from_pylist([{"bins": bins.tobytes(), "label": label.tobytes(), "weight": weight}], schema=packed)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            x, label, weight = _checked(batch, inputs)
            for lo in range(0, len(label), CHUNK):
                some = slice(lo, lo + CHUNK)
                rows.append((x[:, some], label[some], None if weight is None else weight[some]))
                held += len(rows[-1][1])
                if held >= CHUNK:
                    yield item(rows)
                    rows, held = [], 0
        if rows:
            yield item(rows)

    packed = pa.schema([("bins", pa.binary()), ("label", pa.binary()), ("weight", pa.binary())])
    return train.mapInArrow(pack, "bins binary, label binary, weight binary")


# --- passes -----------------------------------------------------------------------

Item = tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]


def _unpacked(row, inputs: int) -> Item:
    label = np.frombuffer(bytes(row.label), dtype=np.int8)
    weight = None if row.weight is None else np.frombuffer(bytes(row.weight))
    return np.frombuffer(bytes(row.bins), dtype=np.uint8).reshape(inputs, -1), label, weight, np.zeros(len(label), dtype=np.float32)


def _slopes(label: np.ndarray, given: np.ndarray, first: bool) -> np.ndarray:
    """What the next tree is to learn: the labels, then the slopes of the logistic loss."""
    if first:
        return label.astype(np.float64)
    sign = label.astype(np.float64)
    out = 2.0 * given
    out = np.exp(np.multiply(sign, out, out=np.empty_like(sign)))
    out += 1.0
    return np.divide(4.0 * sign, out, out=out)


def histograms(items: Iterator[Item], tree: Tree, level: int, first: bool, bins: int, last: bool) -> Iterator[np.ndarray]:
    """Rows, slopes and squared slopes by input, node of the level and bin, summed over all items of a task.

    Squares are those of the first input, but at the ``last`` level, whose children are leaves.
    """
    nodes, total = 2**level, None
    for binned, label, weight, given in items:
        slope = _slopes(label, given, first)
        at = tree.descend(binned, level).astype(np.uint16) * np.uint16(bins)
        size = nodes * bins
        if total is None:
            total = np.zeros((3, len(binned), size))
        weighted = slope if weight is None else slope * weight
        square = weighted * slope
        for k, column in enumerate(binned):
            place = (at + column).astype(np.intp)
            total[0, k] += np.bincount(place, weight, minlength=size)
            total[1, k] += np.bincount(place, weighted, minlength=size)
            if k == 0 or last:
                total[2, k] += np.bincount(place, square, minlength=size)
    if total is not None:
        yield total


def grown(tree: Tree, level: int, sums: np.ndarray, places: list[np.ndarray]) -> bool:
    """Splits the nodes of a level where that lowers the variance most; whether any is split."""
    nodes, bins = 2**level, sums.shape[2] // 2**level
    by_bin = sums.reshape(3, len(places), nodes, bins)
    whole = by_bin[:, 0].sum(-1)
    left = np.cumsum(by_bin, axis=-1)[..., :-1]
    right = whole[:, None, :, None] - left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - (whole[1] ** 2 / whole[0])[None, :, None]) / whole[0][None, :, None]
    allowed = np.arange(bins - 1)[None, None, :] < np.array([len(p) for p in places])[:, None, None]
    gain = np.where(allowed & (left[0] >= 0.5) & (right[0] >= 0.5), gain, -np.inf)
    any_split = False
    for node in range(nodes):
        at = nodes - 1 + node
        if level and not tree.split[(at - 1) // 2]:
            continue
        n, total = whole[0, node], whole[1, node]
        tree.stats[at] = n, total, whole[2, node]
        tree.value[at] = total / n if n else 0.0
        k, cut = np.unravel_index(np.argmax(gain[:, node]), gain[:, node].shape)
        best = gain[k, node, cut]
        impurity = max(whole[2, node] / n - (total / n) ** 2, 0.0) if n else 0.0
        if not best > 1e-12 * max(impurity, 1e-12):
            continue
        any_split = True
        tree.feature[at], tree.cut[at], tree.split[at], tree.gain[at] = k, cut, True, best
        for child, side in ((2 * at + 1, left), (2 * at + 2, right)):
            tree.stats[child] = side[:, k, node, cut]
            tree.value[child] = tree.stats[child, 1] / tree.stats[child, 0]
    return any_split


def _filled(tree: Tree) -> None:
    """The value of a leaf, also where the rows that go left from it end."""
    for at in range(len(tree.split)):
        if not tree.split[at]:
            tree.value[2 * at + 1] = tree.value[at]


def learn(train: DataFrame, inputs: list[str], label: str, weight: str | None, learner: GBTClassifier) -> GBTClassificationModel:
    """The learner's trees for ``train``, over all of its rows."""
    spark = train.sparkSession
    ship(spark)
    use_checkpoints(spark)
    columns = [F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(inputs)]
    read = train.select(*columns, F.col(label).cast("double").alias("_label"), *([F.col(weight).cast("double").alias("_weight")] if weight else []))
    found = {r.feature: (np.frombuffer(bytes(r.value)), np.frombuffer(bytes(r.weight))) for r in _points(read, len(inputs)).collect()}
    if not found:
        raise ValueError("there are no rows to learn from")
    places = [cuts(*found[k], learner.getMaxBins() - 1) for k in range(len(inputs))]
    packed = written(_packed(read, places), "binned")
    count, bins = packed.count(), max(2, *(len(p) + 1 for p in places))
    cores = spark.sparkContext.defaultParallelism
    few = count <= ALONE
    dealt = packed.repartition(1 if few else cores * -(-count // (ITEMS * cores)))
    items = dealt.rdd.map(lambda row, n=len(inputs): _unpacked(row, n))
    depth, rate, trees = learner.getMaxDepth(), learner.getStepSize(), learner.getMaxIter()
    if few:
        found = items.mapPartitions(lambda some: boosted(Here(list(some)), places, bins, depth, rate, trees)).collect()
    else:
        found = list(boosted(Dealt(items, learner.getCheckpointInterval()), places, bins, depth, rate, trees))
    return _model(train, found, places, learner)


class Here:
    """Items of one task, few enough that it takes them all."""

    def __init__(self, items: list[Item]):
        self.items = items

    def sums(self, *asked) -> np.ndarray:
        return next(histograms(iter(self.items), *asked))

    def give(self, tree: Tree, rate: float, depth: int) -> None:
        self.items = [_given(item, tree, rate, depth) for item in self.items]


class Dealt:
    """Items dealt over tasks, kept between passes with what the trees so far give."""

    def __init__(self, items: RDD, interval: int):
        self.items, self.interval, self.given = items.persist(StorageLevel.MEMORY_AND_DISK), interval, 0
        self.earlier: RDD | None = None

    def sums(self, *asked) -> np.ndarray:
        parts = self.items.mapPartitions(lambda some: histograms(some, *asked)).collect()
        if self.earlier is not None:
            self.earlier.unpersist()
            self.earlier = None
        return sum(parts[1:], parts[0])

    def give(self, tree: Tree, rate: float, depth: int) -> None:
        self.earlier, self.items = self.items, self.items.map(lambda item: _given(item, tree, rate, depth))
        self.items.persist(StorageLevel.MEMORY_AND_DISK)
        self.given += 1
        if self.given % self.interval == 0:
            self.items.checkpoint()


def boosted(items: Here | Dealt, places: list[np.ndarray], bins: int, depth: int, rate: float, trees: int) -> Iterator[Tree]:
    """The trees, one after the other; the first counts whole, the others by the rate."""
    for k in range(trees):
        tree = Tree.empty(depth)
        for level in range(depth):
            if not grown(tree, level, items.sums(tree, level, k == 0, bins, level == depth - 1), places):
                break
        _filled(tree)
        if k + 1 < trees:
            items.give(tree, 1.0 if k == 0 else rate, depth)
        yield tree


def _given(item: Item, tree: Tree, rate: float, depth: int) -> Item:
    binned, label, weight, given = item
    return binned, label, weight, given + (rate * tree.value[2**depth - 1 :]).astype(np.float32)[tree.descend(binned, depth)]


# --- Spark's model ------------------------------------------------------------------

def _nodes(tree: Tree, places: list[np.ndarray]) -> list[tuple]:
    """The nodes in Spark's order and form; leaves of equal value below one node are one."""
    leaf: dict[int, bool] = {}

    def is_leaf(at: int) -> bool:
        if at not in leaf:
            ends = at >= len(tree.split) or not tree.split[at]
            below = (2 * at + 1, 2 * at + 2)
            leaf[at] = ends or (all([is_leaf(c) for c in below]) and tree.value[below[0]] == tree.value[below[1]])
        return leaf[at]

    out: list[tuple] = []

    def visit(at: int) -> int:
        number = len(out)
        n, total, square = tree.stats[at].tolist()
        stats = (float(tree.value[at]), max(square / n - (total / n) ** 2, 0.0), [n, total, square], int(round(n)))
        out.append(())
        if is_leaf(at):
            out[number] = (number, *stats, -1.0, -1, -1, (-1, [], -1))
        else:
            k = int(tree.feature[at])
            left, right = visit(2 * at + 1), visit(2 * at + 2)
            out[number] = (number, *stats, float(tree.gain[at]), left, right, (k, [float(places[k][tree.cut[at]])], -1))
        return number

    visit(0)
    return out


_NODE = (
    "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double,"
    " leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"
)


def _model(train: DataFrame, trees: list[Tree], places: list[np.ndarray], learner: GBTClassifier) -> GBTClassificationModel:
    """The trees in the form in which Spark saves such a model, read by Spark."""
    spark = train.sparkSession
    path = f"{shared_dir(spark)}/hearthspark/{spark.sparkContext.applicationId}/trees-{uuid.uuid4().hex}"
    given, default = ({p.name: v for p, v in m.items()} for m in (learner._paramMap, learner._defaultParamMap))
    common = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    classes = "org.apache.spark.ml"
    whole = common | {
        "class": f"{classes}.classification.GBTClassificationModel", "uid": learner.uid, "paramMap": given, "defaultParamMap": default,
        "numFeatures": len(places), "numTrees": len(trees),
    }
    of_tree = {"maxDepth", "seed", "labelCol", "maxBins", "checkpointInterval"}
    known = {"cacheNodeIds", "checkpointInterval", "featuresCol", "impurity", "labelCol", "leafCol", "maxBins", "maxDepth", "maxMemoryInMB",
             "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed"}
    each = [
        json.dumps(
            common | {
                "class": f"{classes}.regression.DecisionTreeRegressionModel", "uid": f"dtr_{learner.uid}_{k}",
                "paramMap": {n: v for n, v in given.items() if n in of_tree}, "defaultParamMap": {n: v for n, v in default.items() if n in known},
            }
        )
        for k in range(len(trees))
    ]
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    rates = [1.0] + [learner.getStepSize()] * (len(trees) - 1)
    spark.createDataFrame(list(zip(range(len(trees)), each, rates, strict=True)), "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
    rows = [(k, node) for k, tree in enumerate(trees) for node in _nodes(tree, places)]
    spark.createDataFrame(rows, _NODE).write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)
