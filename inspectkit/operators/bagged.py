"""M7 on large tables: a random forest grown level by level over binned columns.

Spark ML's forest keeps each row with a draw for every tree and finds the row's node
tree by tree in boxed maps.  Here a row is a few small bins.  A pass per level counts,
in the tasks, the classes by (node, slot, bin) of all trees at once; the counts of a few
nodes at a time are added up and split where the Gini gain is largest, again in tasks; the
driver holds the nodes only, as Spark ML's does.  All else is as there: bootstrap weights
(Poisson of mean 1), sqrt(slots) slots drawn for each node, 32 bins for a number whose
bounds come from a draw of rows, two for a one-hot slot, leaves that agree are merged.

A row's weight in a tree is made from its position and the seed, and so are a node's
slots: no draw is kept, and the forest is the same however the rows are partitioned.
The result is a Spark ML model: it is stored, loaded and applied as any other.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectkit.session import scratch_path

POSITION, LABEL = "__pos", "__y"
BINS = 32
BOUND_ROWS = 100_000  # rows drawn for the bounds of bins; Spark ML draws 10,000
CHUNK = 65_536  # rows worked on at a time
CELLS = 2**24  # counts that a task holds: more nodes need another pass
PART_CELLS = 2**16  # counts of the nodes that are added up together

SPLITS = "tree int, node int, slot int, bin int, gain double, below array<double>, above array<double>"
NODE = ("id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, "
        "leftChild int, rightChild int, split struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>")


@dataclass(frozen=True)
class Binned:
    """Column ``b<i>`` of the binned rows: a number by its bounds, or a text of ``values``
    one-hot slots.  Slots follow the order of the columns."""
    bounds: tuple[float, ...] = ()
    values: int = 0

    def slot_bins(self) -> list[int]:
        return [2] * self.values if self.values else [len(self.bounds) + 1]


def bounds_of(values: np.ndarray, bins: int = BINS) -> tuple[float, ...]:
    """Bounds between the bins of a number, halfway between values next to each other: all
    of them where there are few, else at equal steps of the rows, as Spark ML sets them."""
    found, n = np.unique(values[~np.isnan(values)], return_counts=True)
    with np.errstate(over="ignore", invalid="ignore"):
        middle = found[:-1] + (found[1:] - found[:-1]) / 2
    middle = np.where(np.isfinite(middle) & (middle < found[1:]), middle, found[:-1])
    if len(middle) < bins:
        return tuple(map(float, middle))
    step = n.sum() / bins
    out, upto, wanted = [], n[0], step
    for i in range(len(middle)):
        if abs(upto - wanted) < abs(upto + n[i + 1] - wanted):
            out.append(float(middle[i]))
            wanted += step
        upto += n[i + 1]
    return tuple(out[: bins - 1])


def drawn_bounds(df: DataFrame, numbers: list[str], rows: int, seed: int) -> list[tuple[float, ...]]:
    """Bounds of each number from about BOUND_ROWS of the rows, drawn by their position."""
    if not numbers:
        return []
    nth = max(1, rows // BOUND_ROWS)
    found = df.where(F.pmod(F.xxhash64(POSITION, F.lit(seed)), F.lit(nth)) == 0).select(*numbers).toArrow()
    return [bounds_of(found[c].to_numpy()) for c in numbers]


def binned_rows(df: DataFrame, numbers: list[str], texts: list[str], label: str, bounds: list[tuple[float, ...]]) -> DataFrame:
    """Position, bins b0, b1, ... and class of each row.  A number's bin is how many bounds
    lie below it, NaN above all; a text's is its index."""
    names = [f"b{i}" for i in range(len(numbers) + len(texts))]
    edges = [np.array(b) for b in bounds]

    def bins(batches):
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
            out = [np.searchsorted(e, x).astype(np.int32) for e, x in zip(edges, cols[1:])]
            out += [x.astype(np.int32) for x in cols[1 + len(edges):]]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out)], names=[POSITION, *names, LABEL])

    cols = [F.col(c).cast("double") for c in numbers] + [F.col(c).cast("int") for c in [*texts, label]]
    schema = f"{POSITION} bigint, " + "".join(f"{c} int, " for c in names) + f"{LABEL} int"
    return df.select(POSITION, *cols).mapInArrow(bins, schema)


# ---------------------------------------------------------------- in the tasks


def mixed(pos: np.ndarray, seed: int) -> np.ndarray:
    """64 well mixed bits of each position (the finisher of splitmix64)."""
    x = pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % 2**64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _poisson() -> np.ndarray:
    """The Poisson value of mean 1 for each number of 16 bits."""
    upto = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
    return np.searchsorted(upto, (np.arange(65536) + 0.5) / 65536).astype(np.uint8)


def weights(bits: np.ndarray, tree: int, seed: int, table: np.ndarray) -> np.ndarray:
    """How often the bootstrap of a tree draws each row."""
    by = np.random.default_rng([seed % 2**64, tree]).integers(2**63, size=2, dtype=np.uint64) | np.uint64(1)
    x = bits * by[0]
    x ^= x >> np.uint64(32)
    x *= by[1]
    x >>= np.uint64(48)
    return table.take(x.view(np.int64))


def _chunks(batches, size: int):
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, size):
            held.append(b.slice(at, size))
            n += held[-1].num_rows
            if n >= size:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _slot_rows(bins: list[np.ndarray], y: np.ndarray, columns: list[Binned], classes: int, kind: np.dtype) -> np.ndarray:
    """A line per slot: bin * classes + class of each row."""
    x = np.empty((sum(len(c.slot_bins()) for c in columns), len(y)), kind)
    at = 0
    for b, c in zip(bins, columns):
        if c.values:
            for v in range(c.values):
                x[at + v] = (b == v) * classes + y
        else:
            x[at] = b * classes + y
        at += len(c.slot_bins())
    return x


@dataclass
class _Tables:
    """A tree as rows walk it, and the nodes of this pass.  The children of a node are
    ``left`` and the next; a leaf leads to itself.  ``at``: a node's line in ``pick``
    (its slots) and ``base`` (where their counts begin), -1 if not of this pass."""
    tree: int
    slot: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    at: np.ndarray
    pick: np.ndarray
    base: np.ndarray
    cells: int


def _walked(flat: np.ndarray, n: int, rows: np.ndarray, slot: np.ndarray, cut: np.ndarray, left: np.ndarray, steps: int) -> np.ndarray:
    """The node of each of ``rows`` after so many steps down a tree; ``flat``: n rows, slot after slot."""
    node, line = np.zeros(len(rows), np.int64), slot * n
    for _ in range(steps):
        f = line.take(node)
        f += rows
        right = flat.take(f) > cut.take(node)
        node = left.take(node)
        node += right
    return node


def _counted(tables: list[_Tables], x: np.ndarray, bits: np.ndarray, level: int, seed: int, bootstrap: bool, table: np.ndarray,
             held: list[np.ndarray]) -> None:
    """Add to ``held`` the rows of a chunk by (node, slot, bin, class), tree by tree."""
    n, flat = x.shape[1], x.ravel()
    for t, counts in zip(tables, held):
        w = weights(bits, t.tree, seed, table) if bootstrap else np.ones(n, np.uint8)
        rows = np.flatnonzero(w)
        at = t.at.take(_walked(flat, n, rows, t.slot, t.cut, t.left, level))
        if at.size and at.min() < 0:
            here = np.flatnonzero(at >= 0)
            rows, at = rows.take(here), at.take(here)
        w = w.take(rows).astype(np.float64)
        for j in range(t.pick.shape[1]):
            f = (t.pick[:, j] * n).take(at)
            f += rows
            cell = t.base[:, j].take(at)
            cell += flat.take(f)
            counts += np.bincount(cell, w, minlength=t.cells)


def _split(counts: np.ndarray, pick: np.ndarray, slot_bins: np.ndarray, classes: int):
    """Of nodes whose counts lie one after the other: slot, bin and gain of the best split,
    with the classes below and above it; slot -1 and all rows below where no split gains."""
    nodes, m = pick.shape
    bins = slot_bins[pick]
    base = (np.cumsum(bins) - bins.ravel()).reshape(nodes, m)
    counts = counts.reshape(-1, classes)
    gain, cut = np.full((nodes, m), -1.0), np.zeros((nodes, m), np.int64)
    below = np.zeros((nodes, m, classes))
    upto = np.concatenate([np.zeros((1, classes)), np.cumsum(counts, axis=0)])
    total = upto[base[:, 0] + bins[:, 0]] - upto[base[:, 0]]
    for k in np.unique(bins[bins > 1]):
        i, j = np.nonzero(bins == k)
        low = np.cumsum(counts[base[i, j][:, None] + np.arange(k - 1)], axis=1)
        all_ = total[i][:, None, :]
        high = all_ - low
        a, b, n = low.sum(axis=2), high.sum(axis=2), all_.sum(axis=2)
        with np.errstate(divide="ignore", invalid="ignore"):
            g = ((low**2).sum(axis=2) / a + (high**2).sum(axis=2) / b - (all_**2).sum(axis=2) / n) / n
        g = np.where((a > 0) & (b > 0), g, -1.0)
        best = g.argmax(axis=1)
        e = np.arange(len(i))
        gain[i, j], cut[i, j], below[i, j] = g[e, best], best, low[e, best]
    e, best = np.arange(nodes), gain.argmax(axis=1)
    good = gain[e, best] > 1e-15
    left = np.where(good[:, None], below[e, best], total)
    return np.where(good, pick[e, best], -1), cut[e, best], gain[e, best], left, total - left


def _narrow(counts: np.ndarray) -> np.ndarray:
    """The same counts in the fewest bytes of 1, 2, 4 or 8."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


# ---------------------------------------------------------------- on the driver


class _Tree:
    """Nodes in the order of their making; ``active``: those of the last level that may split."""

    def __init__(self, classes: int):
        self.slot, self.bin, self.left = (np.zeros(1, np.int64) - 1 for _ in range(3))
        self.gain, self.counts = np.zeros(1) - 1, np.zeros((1, classes))
        self.active = np.zeros(1, np.int64)

    def grow(self, node, slot, cut, gain, below, above, last: bool) -> None:
        if not node[0]:
            self.counts[0] = below[0] + above[0]
        good = slot >= 0
        node, slot, cut, gain, below, above = (v[good] for v in (node, slot, cut, gain, below, above))
        size, k = len(self.slot), len(node)
        self.slot[node], self.bin[node], self.gain[node] = slot, cut, gain
        self.left[node] = size + 2 * np.arange(k)
        new = np.stack([below, above], axis=1).reshape(2 * k, self.counts.shape[1])
        self.counts = np.concatenate([self.counts, new])
        self.slot, self.bin, self.left, self.gain = (np.concatenate([v, np.full(2 * k, -1, v.dtype)]) for v in (self.slot, self.bin, self.left, self.gain))
        self.active = np.zeros(0, np.int64) if last else size + np.flatnonzero((new > 0).sum(axis=1) > 1)

    def merged(self) -> None:
        """Two leaves that predict the same become one, upwards; their nodes go."""
        says = self.counts.argmax(axis=1)
        gone = np.zeros(len(says), bool)
        for i in range(len(says) - 1, -1, -1):
            a = self.left[i]
            if a >= 0 and self.left[a] < 0 and self.left[a + 1] < 0 and says[a] == says[a + 1]:
                gone[[a, a + 1]] = True
                self.slot[i] = self.bin[i] = self.left[i] = self.gain[i] = -1
        name = np.cumsum(~gone) - 1
        self.slot, self.bin, self.gain, self.counts = (v[~gone] for v in (self.slot, self.bin, self.gain, self.counts))
        left = self.left[~gone]
        self.left = np.where(left >= 0, name[left], -1)


def _passes(trees: list[_Tree], level: int, slots: int, m: int, seed: int, slot_bins: np.ndarray, classes: int):
    """The nodes of a level in passes of at most CELLS counts (one node at least): a pass is a list
    of (tree, nodes, their slots).  The slots of a node are drawn without replacement."""
    out, room = [[]], CELLS
    for i, t in enumerate(trees):
        if not len(t.active):
            continue
        draw = np.random.default_rng([seed % 2**64, i, level])
        step = max(1, 2**20 // slots)
        pick = np.concatenate([
            np.sort(np.argsort(draw.random((len(t.active[a : a + step]), slots)), axis=1)[:, :m], axis=1)
            for a in range(0, len(t.active), step)])
        ends = np.cumsum(slot_bins[pick].sum(axis=1)) * classes
        a = 0
        while a < len(ends):
            b = max(int(np.searchsorted(ends, room + (ends[a - 1] if a else 0), "right")), a)
            if b == a and out[-1]:
                out.append([])
                room = CELLS
                continue
            b = max(b, a + 1)
            out[-1].append((i, t.active[a:b], pick[a:b]))
            room -= int(ends[b - 1] - (ends[a - 1] if a else 0))
            a = b
    return [p for p in out if p]


def _run_pass(rows: DataFrame, trees: list[_Tree], now: list, level: int, columns: list[Binned], classes: int, seed: int,
              bootstrap: bool) -> pa.Table:
    slot_bins = np.array([b for c in columns for b in c.slot_bins()], np.int64)
    kind = np.min_scalar_type(int(slot_bins.max()) * classes)
    tables, parts = [], []
    for i, nodes, pick in now:
        t = trees[i]
        leaf = t.left < 0
        cells = slot_bins[pick] * classes
        base = (np.cumsum(cells) - cells.ravel()).reshape(pick.shape)
        at = np.full(len(t.left), -1, np.int64)
        at[nodes] = np.arange(len(nodes))
        cut = np.where(leaf, np.iinfo(kind).max, t.bin * classes + classes - 1).astype(kind)
        tables.append(_Tables(i, np.maximum(t.slot, 0), cut, np.where(leaf, np.arange(len(leaf)), t.left), at, pick, base, int(cells.sum())))
        ends = np.cumsum(cells.sum(axis=1))
        a = 0
        while a < len(ends):
            done = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + PART_CELLS, "right")))
            parts.append((len(tables) - 1, a, b, done, int(ends[b - 1])))
            a = b
    of = [[] for _ in tables]
    for k, p in enumerate(parts):
        of[p[0]].append((k, p[3], p[4]))
    size = max(1024, min(CHUNK, 2**22 // len(slot_bins)))

    def count(batches):
        held, table = [np.zeros(t.cells) for t in tables], _poisson()
        for chunk in _chunks(batches, size):
            bits = mixed(chunk[POSITION].to_numpy(), seed)
            x = _slot_rows([chunk[f"b{i}"].to_numpy() for i in range(len(columns))], chunk[LABEL].to_numpy(), columns, classes, kind)
            _counted(tables, x, bits, level, seed, bootstrap, table, held)
        for counts, own in zip(held, of):
            small = [_narrow(counts[a:b]) for _, a, b in own]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in own], pa.int32()), pa.array([s.itemsize for s in small], pa.int32()),
                                              pa.array([s.tobytes() for s in small], pa.binary())], names=["part", "width", "counts"])

    def split(key, found):
        k, a, b, first, end = parts[key[0].as_py()]
        i, nodes, pick = now[k]
        counts = np.zeros(end - first)
        for width, cells in zip(found["width"].to_pylist(), found["counts"]):
            counts += np.frombuffer(cells.as_buffer(), f"u{width}")
        slot, cut, gain, below, above = _split(counts, pick[a:b], slot_bins, classes)
        listed = lambda v: pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * classes, v.ravel())
        return pa.table({"tree": pa.array(np.full(b - a, i), pa.int32()), "node": pa.array(nodes[a:b], pa.int32()), "slot": pa.array(slot, pa.int32()),
                         "bin": pa.array(cut, pa.int32()), "gain": pa.array(gain, pa.float64()), "below": listed(below), "above": listed(above)})

    counted = rows.mapInArrow(count, "part int, width int, counts binary")
    return counted.groupBy("part").applyInArrow(split, SPLITS).toArrow()


def grown(rows: DataFrame, columns: list[Binned], classes: int, trees: int, depth: int, seed: int, bootstrap: bool) -> list[_Tree]:
    """The trees over binned rows, all of which every tree sees.  A single tree draws no slots, as in Spark ML."""
    slot_bins = np.array([b for c in columns for b in c.slot_bins()], np.int64)
    slots = len(slot_bins)
    m = slots if trees == 1 else math.ceil(math.sqrt(slots))
    forest = [_Tree(classes) for _ in range(trees)]
    for level in range(depth):
        passes = _passes(forest, level, slots, m, seed, slot_bins, classes)
        if not passes:
            break
        found = pa.concat_tables([_run_pass(rows, forest, now, level, columns, classes, seed, bootstrap) for now in passes])
        found = found.sort_by([("tree", "ascending"), ("node", "ascending")]).combine_chunks()
        tree, plain = found["tree"].to_numpy(), [found[c].to_numpy() for c in ("node", "slot", "bin", "gain")]
        sides = [found[c].combine_chunks().flatten().to_numpy().reshape(-1, classes) for c in ("below", "above")]
        starts = np.flatnonzero(np.diff(tree, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(tree)]):
            forest[tree[a]].grow(*[v[a:b] for v in [*plain, *sides]], level + 1 == depth)
    for t in forest:
        t.merged()
    return forest


# ---------------------------------------------------------------- the model


def _metadata(kind: str, params: dict, defaults: dict, **more) -> str:
    return json.dumps({"class": f"org.apache.spark.ml.classification.{kind}", "timestamp": int(time.time() * 1000), "paramMap": params,
                       "defaultParamMap": defaults, **more})


def spark_model(spark: SparkSession, rf: RandomForestClassifier, forest: list[_Tree], columns: list[Binned], classes: int) -> RandomForestClassificationModel:
    """The trees as the model that ``rf`` would return, by Spark ML's format of stored models.  ``classes``: of the label column,
    those without rows too."""
    path = scratch_path(spark, "forest")
    bounds = [b for c in columns for b in ([None] * c.values if c.values else [c.bounds])]
    hot = np.array([b is None for b in bounds])
    named = lambda m: {p.name: v for p, v in m.items()}
    same = {"sparkVersion": spark.version}
    params, defaults = named(rf._paramMap), named(rf._defaultParamMap)
    of_tree = {k: v for k, v in params.items() if k in ("featuresCol", "labelCol", "maxDepth", "seed")}
    text = _metadata("RandomForestClassificationModel", params, defaults, uid=rf.uid, numFeatures=len(bounds), numClasses=classes,
                     numTrees=len(forest), **same)
    spark.createDataFrame(pa.table({"value": [text]})).coalesce(1).write.text(f"{path}/metadata")
    each = [_metadata("DecisionTreeClassificationModel", of_tree, {}, uid=f"{rf.uid}_tree_{i}", **same) for i in range(len(forest))]
    of_trees = pa.table({"_1": pa.array(range(len(forest)), pa.int32()), "_2": each, "_3": [1.0] * len(forest)})
    spark.createDataFrame(of_trees).coalesce(1).write.parquet(f"{path}/treesMetadata")
    tree, counts = np.repeat(np.arange(len(forest)), [len(t.left) for t in forest]), np.concatenate([t.counts for t in forest])
    slot, cut, left, gain = (np.concatenate([getattr(t, v) for t in forest]) for v in ("slot", "bin", "left", "gain"))
    n = counts.sum(axis=1)
    stats = np.pad(counts, ((0, 0), (0, classes - counts.shape[1])))
    # a one-hot slot splits as Spark ML's: the category 0 goes left
    inner = slot >= 0
    at = np.array([0.0 if hot[s] else bounds[s][b] for s, b in zip(slot[inner], cut[inner])])
    nodes = pa.table({
        "treeID": pa.array(tree, pa.int32()), "id": pa.array(np.concatenate([np.arange(len(t.left)) for t in forest]), pa.int32()),
        "prediction": counts.argmax(axis=1).astype(float), "impurity": 1 - (counts**2).sum(axis=1) / np.maximum(n, 1) ** 2,
        "impurityStats": pa.ListArray.from_arrays(np.arange(len(stats) + 1, dtype=np.int32) * classes, stats.ravel()),
        "rawCount": n.astype(np.int64), "gain": gain, "leftChild": pa.array(left, pa.int32()),
        "rightChild": pa.array(np.where(left >= 0, left + 1, -1), pa.int32()), "featureIndex": pa.array(slot, pa.int32()),
        "leftCategoriesOrThreshold": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(inner)]).astype(np.int32), at),
        "numCategories": pa.array(np.where(inner & hot[slot], 2, -1), pa.int32())})
    fields = ["featureIndex", "leftCategoriesOrThreshold", "numCategories"]
    node = [c for c in nodes.column_names if c not in ("treeID", *fields)]
    data = spark.createDataFrame(nodes).select("treeID", F.struct(*node, F.struct(*fields).alias("split")).cast(f"struct<{NODE}>").alias("nodeData"))
    data.write.parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)


# ---------------------------------------------------------------- scoring


def _stored_trees(forest: RandomForestClassificationModel) -> tuple[pa.Table, np.ndarray]:
    """The nodes of a model, tree by tree, as Spark ML stores them, and where each tree begins."""
    path = scratch_path(SparkSession.active(), "forest")
    forest.write().save(path)
    nodes = SparkSession.active().read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.impurityStats", F.col("nodeData.split.featureIndex").alias("slot"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("bound"), "nodeData.split.numCategories").toArrow()
    nodes = nodes.sort_by([("treeID", "ascending"), ("id", "ascending")]).combine_chunks()
    return nodes, np.flatnonzero(np.diff(nodes["treeID"].to_numpy(), prepend=-1))


def _walkable(slot: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray, share: np.ndarray, most: int):
    """A tree for ``_walked``: its nodes renumbered so that children stand side by side; the levels; a leaf's shares."""
    inner = np.flatnonzero(left >= 0)
    name = np.zeros(len(left), np.int64)
    name[left[inner]], name[right[inner]] = 2 * np.arange(len(inner)) + 1, 2 * np.arange(len(inner)) + 2
    to, limit, at = np.arange(len(left)), np.full(len(left), most, cut.dtype), np.zeros(len(left), np.int64)
    to[name[inner]], limit[name[inner]], at[name[inner]] = name[left[inner]], cut[inner], slot[inner]
    shares = np.zeros_like(share)
    shares[name] = share
    steps, level = 0, np.zeros(1, np.int64)
    while len(level := level[left[level] >= 0]):
        level = np.concatenate([left[level], right[level]])
        steps += 1
    return at, limit, to, shares, steps


def votes(forest: RandomForestClassificationModel, numbers: list[str], texts: list[str], values: list[int]) -> Column:
    """``rawPrediction`` of a model as an array, number for number what Spark ML's own transform
    gives.  Its slots are the numbers, then ``values`` one-hot slots of each text's index.

    Spark ML follows pointers row by row, 1,500 of them for 150 trees of 10 levels; here
    the rows of a batch go down a tree together."""
    nodes, starts = _stored_trees(forest)
    slot, bound = nodes["slot"].to_numpy(), nodes["bound"].to_numpy()
    left, right = nodes["leftChild"].to_numpy(), nodes["rightChild"].to_numpy()
    # of a one-hot slot, the first category that goes left: 0, or 1 with 0 on the right
    turned = (nodes["numCategories"].to_numpy() == 2) & (bound == 1)
    left, right = np.where(turned, right, left), np.where(turned, left, right)
    bounds = [np.unique(bound[slot == s]) for s in range(len(numbers))]
    columns = [Binned(tuple(map(float, b))) for b in bounds] + [Binned(values=v) for v in values]
    kind = np.min_scalar_type(max([2, *(len(b) + 1 for b in bounds)]))
    cut = np.zeros(len(slot), kind)
    for s, b in enumerate(bounds):
        cut[slot == s] = np.searchsorted(b, bound[slot == s])
    classes = forest.numClasses
    stats = nodes["impurityStats"].combine_chunks().flatten().to_numpy().reshape(-1, classes)
    total = np.zeros(len(stats))
    for k in range(classes):  # one after the other, as Spark ML adds them
        total += stats[:, k]
    share = np.divide(stats, total[:, None], out=np.zeros_like(stats), where=total[:, None] != 0)
    trees = [_walkable(*[v[a:b] for v in (slot, cut, left, right, share)], np.iinfo(kind).max) for a, b in zip(starts, [*starts[1:], len(slot)])]
    size = max(1024, 2**22 // max(1, len(numbers) + sum(values)))

    def walk(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in (batch if isinstance(batch, tuple) else (batch,))]
            out = np.zeros((len(cols[0]), classes))
            for a in range(0, len(out), size):
                bins = [np.searchsorted(b, c[a : a + size]) for b, c in zip(bounds, cols)] + [c[a : a + size] for c in cols[len(bounds):]]
                n = len(bins[0])
                flat, rows = _slot_rows(bins, np.zeros(n, kind), columns, 1, kind).ravel(), np.arange(n)
                for at, limit, to, shares, steps in trees:
                    out[a : a + size] += shares.take(_walked(flat, n, rows, at, limit, to, steps), axis=0)
            yield pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * classes, out.ravel())

    return F.arrow_udf(walk, "array<double>")(*[F.col(c).cast("double") for c in [*numbers, *texts]])
