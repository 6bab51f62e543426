"""Boosted trees for medians and quantiles: many models in one pass over one stored table.

Features are binned once and stored, for the fit in blocks of rows of one group, feature by feature.
In each round every model grows one tree: a job for each level counts gradients by model, node,
feature and bin, the driver picks the splits (it receives counts, whose number does not depend on the
rows), and two more jobs take the quantile of the residuals in each leaf: one narrows it down by
points of every task, the other counts within what is left, so it is exact and no task holds a leaf.
The tuning loss of all models is summed on the way, and a model stops once it has not improved for
some rounds. Scores are stored every few rounds, so no round goes back to the first tree.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopwise.sources.shared import stored

#: Bins of a number, missing ones in bin 0; a category has at most as many values.
BINS = 64
FIT, TUNE, OTHER = 0, 1, 2
#: Rounds between two stored scores.
EVERY = 4
#: Rows of a block, values that a task gives of a leaf, and rows of a model that a task holds before it gives them.
BLOCK, POINTS, HELD = 16_384, 512, 1 << 20


@dataclass
class Binning:
    """Inner cut points of each number, and values of each category in order of their bin."""

    cuts: dict[str, list[float]]
    values: dict[str, list[str]]

    @property
    def names(self) -> list[str]:
        return [*self.cuts, *self.values]


def binning(df: DataFrame, numbers: list[str], names: list[str], bins: int = BINS) -> Binning:
    """Bins from the rows given: a row a feature and at most ``bins`` values each reach the driver. Values beyond the commonest share the missing bin."""
    levels = F.array(*[F.lit(i / (bins - 1)) for i in range(1, bins - 1)])
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), levels, F.lit(100 * bins)).alias(c) for c in numbers]).first() if numbers else None
    cuts = {c: sorted(set(row[c] or [])) for c in numbers}
    values: dict[str, list[str]] = {c: [] for c in names}
    if names:
        counts = df.select(*[F.col(c).cast("string").alias(c) for c in names]).unpivot([], names, "name", "value").where("value is not null").groupBy("name", "value").count()
        place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("count"), "value"))
        for r in counts.withColumn("place", place).where(F.col("place") < bins).collect():
            values[r["name"]].append(r["value"])
        values = {c: sorted(v) for c, v in values.items()}
    return Binning(cuts, values)


def _binned(batch: pa.RecordBatch, b: Binning) -> np.ndarray:
    """The bins of a batch's features, a byte each, in a row a feature: 0 for missing and unknown."""
    x = np.zeros((len(b.names), batch.num_rows), np.uint8)
    for i, (c, cuts) in enumerate(b.cuts.items()):
        known = batch.column(c).is_valid().to_numpy(zero_copy_only=False)
        x[i, known] = 1 + np.searchsorted(np.array(cuts, float), batch.column(c).drop_null().to_numpy(), "right")
    for i, (c, values) in enumerate(b.values.items(), len(b.cuts)):
        x[i] = pc.fill_null(pc.index_in(batch.column(c), value_set=pa.array(values, pa.string())), -1).to_numpy() + 1
    return x


@dataclass
class Tree:
    """A complete tree: split feature and bin of each inner node (-1: all go left), and the value of each leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray, depth: int) -> np.ndarray:
        """Which node at a depth each row comes to; ``x`` holds a row a feature."""
        node, path = np.zeros(x.shape[1], np.uint8), []
        for level in range(depth):
            first = (1 << level) - 1
            # every node's question is put to all rows, and the answers are chosen by the way a row came
            go = [x[self.feature[k]] > self.cut[k] if self.feature[k] >= 0 else np.False_ for k in range(first, 2 * first + 1)]
            for turned in path:
                half = len(go) // 2
                go = [a if a is b else np.where(turned, b, a) for a, b in zip(go[:half], go[half:], strict=True)]
            path.append(go[0])
            node = 2 * node + go[0]
        return node


@dataclass
class Model:
    """The trees of one group of rows at one level of the pinball loss, from some of the features."""

    name: str
    group: int
    alpha: float
    features: list[int]
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    gain: dict[int, float] = field(default_factory=dict)
    done: bool = False

    @property
    def best(self) -> int:
        """The number of trees with the least tuning loss."""
        return int(np.argmin(self.losses)) if self.losses else len(self.trees)


@dataclass
class Block:
    """Rows of one group: part, target, random number, bins (a row a feature) and stored scores (a row a model of the group)."""

    group: int
    part: np.ndarray
    y: np.ndarray
    u: np.ndarray
    x: np.ndarray
    f: np.ndarray


BLOBS = {"part": np.int8, "y": np.float64, "u": np.int64, "x": np.uint8, "f": np.float64}
BLOCKS = "g int, part binary, y binary, u binary, x binary, f binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            part, y, u, x, f = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in BLOBS.items())
            yield Block(batch.column("g")[i].as_py(), part, y, u, x.reshape(-1, len(y)), f.reshape(-1, len(y)))


def _packed(b: Block) -> pa.RecordBatch:
    blobs = [pa.array([np.ascontiguousarray(getattr(b, c), t).tobytes()], pa.binary()) for c, t in BLOBS.items()]
    return pa.RecordBatch.from_arrays([pa.array([b.group], pa.int32()), *blobs], ["g", *BLOBS])


def _bins_of(batch: pa.RecordBatch) -> np.ndarray:
    """A batch's bins, a row a feature. Rows have as many bytes each, so the column's values lie one after another."""
    if not batch.num_rows:
        return np.zeros((0, 0), np.uint8)
    x = batch.column("x")
    ends = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
    return np.ascontiguousarray(np.frombuffer(x.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(x), -1).T)


def _as_bytes(x: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes as one column of values."""
    n, wide = x.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * wide), pa.py_buffer(np.ascontiguousarray(x))])


def _pack(table: DataFrame, models: list[Model], parts: set[int]) -> DataFrame:
    """The known rows of these parts in blocks of one group each, scores at 0; stored, as every job of a fit reads them.

    Blocks are dealt evenly to twice as many files as tasks run at once, so that no pass over them waits for a last task.
    """
    held = {g: sum(m.group == g for m in models) for g in {m.group for m in models}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[Block]] = {}

        def full(g: int) -> pa.RecordBatch:
            many = kept.pop(g)
            join = lambda c: np.concatenate([getattr(b, c) for b in many], axis=-1)
            return _packed(Block(g, join("part"), join("y"), join("u"), join("x"), join("f")))

        for batch in batches:
            group, part, y, u = (batch.column(c).to_numpy() for c in ("g", "part", "y", "u"))
            x = _bins_of(batch)
            for g in np.unique(group).tolist():
                own = group == g
                kept.setdefault(g, []).append(Block(g, part[own], y[own], u[own], x[:, own], np.zeros((held[g], int(own.sum())))))
                if sum(len(b.y) for b in kept[g]) >= BLOCK:
                    yield full(g)
        for g in list(kept):
            yield full(g)

    rows = table.where(F.col("y").isNotNull() & F.col("part").isin(*parts) & F.col("g").isin(*held))
    blocks = rows.select("g", "part", "y", "u", "x").mapInArrow(run, BLOCKS)
    return stored(blocks.repartition(2 * table.sparkSession.sparkContext.defaultParallelism), "blocks")


def _kept(u: np.ndarray, turn: int, share: float) -> np.ndarray:
    """Which rows a round learns from: a share drawn anew each round from a row's random number."""
    h = (u.view(np.uint64) ^ np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    return (h & np.uint64(0xFFFFFF)) < np.uint64(int(share * (1 << 24)))


def _sums(table: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], dict[int, tuple[np.ndarray, np.ndarray]]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """``work`` of every task, counts and tuning loss of each model, added up by tasks of their own; the driver receives one array a model."""
    names = ["model", "counts", "loss"]

    def rows(found: dict[int, tuple[np.ndarray, np.ndarray]], kind: type) -> pa.RecordBatch:
        blobs = [pa.array([v[k].astype(t).tobytes() for v in found.values()], pa.binary()) for k, t in ((0, kind), (1, np.float64))]
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), *blobs], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield rows(work(batches), np.uint32)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for m, a, b in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                v = np.frombuffer(a, np.uint32).astype(np.int64), np.frombuffer(b, np.float64)
                total[m] = (total[m][0] + v[0], total[m][1] + v[1]) if m in total else v
        yield rows(total, np.int64)

    form = "model int, counts binary, loss binary"
    found = table.mapInArrow(each, form).repartition("model").mapInArrow(add, form).collect()
    return {r["model"]: (np.frombuffer(r["counts"], np.int64), np.frombuffer(r["loss"], np.float64)) for r in found}


def _scores(m: Model, x: np.ndarray, f: np.ndarray | None, since: int, rate: float, depth: int, upto: int | None = None) -> np.ndarray:
    """The model's scores: those stored (the base, before any tree), and the trees since then."""
    out = f.copy() if since else np.full(x.shape[1], m.base)
    for t in m.trees[since:upto]:
        out += (rate * t.value)[t.leaves(x, depth)]
    return out


def _pinball(d: np.ndarray, alpha: float) -> np.ndarray:
    return np.maximum(alpha * d, (alpha - 1) * d)


def _counts(x: np.ndarray, above: np.ndarray, node: np.ndarray, features: list[int], nodes: int) -> np.ndarray:
    """Rows by node, feature, bin and whether their residual is above 0."""
    base, out = node.astype(np.int16 if nodes < 128 else np.int64) * (2 * (BINS + 1)) + above, np.zeros((nodes, len(features), 2 * (BINS + 1)), np.int64)
    for k, f in enumerate(features):
        out[:, k] = np.bincount(base + 2 * x[f].astype(base.dtype), minlength=nodes * 2 * (BINS + 1)).reshape(nodes, -1)
    return out


def _splits(m: Model, counts: np.ndarray, tree: Tree, level: int, least: int) -> None:
    """The best split of each node of a level, by the sums of gradients on both sides."""
    features = sorted(m.features)
    if not features:
        return
    below, above = np.moveaxis(counts.reshape(1 << level, len(features), BINS + 1, 2), -1, 0)
    for node in range(1 << level):
        at = node + (1 << level) - 1
        c, up = np.cumsum(below[node] + above[node], axis=1), np.cumsum(above[node], axis=1)
        g = m.alpha * up + (m.alpha - 1) * (c - up)
        n, s = c[:, -1:], g[:, -1:]
        left, right = c[:, :-1], n - c[:, :-1]
        fits = (left >= least) & (right >= least)
        gain = np.where(fits, g[:, :-1] ** 2 / np.maximum(left, 1) + (s - g[:, :-1]) ** 2 / np.maximum(right, 1) - s**2 / np.maximum(n, 1), -1.0)
        f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
        if gain[f, b] > 1e-9:
            tree.feature[at], tree.cut[at] = features[f], b
            m.gain[features[f]] = m.gain.get(features[f], 0.0) + float(gain[f, b])


def _points(model: int, leaf: np.ndarray, d: np.ndarray) -> Iterator[tuple]:
    """Of each leaf up to about ``POINTS`` of a task's values, with how many are below and not above each."""
    order = np.argsort(leaf, kind="stable")
    leaf, d = leaf[order], d[order]
    for k, own in zip(leaf[np.r_[True, leaf[1:] != leaf[:-1]]].tolist(), np.split(d, np.flatnonzero(leaf[1:] != leaf[:-1]) + 1), strict=True):
        v, c = np.unique(own, return_counts=True)
        upto = np.cumsum(c)
        at = np.unique(np.r_[0, np.searchsorted(upto, np.linspace(0, upto[-1], POINTS)[1:])]) if len(v) > POINTS else np.arange(len(v))
        yield model, k, int(upto[-1]), v[at].tobytes(), (upto - c)[at].tobytes(), upto[at].tobytes()


def _between(alpha: float, n: list[int], points: list[np.ndarray], below: list[np.ndarray], upto: list[np.ndarray]) -> tuple[int, float, float, bool]:
    """``(rank, low, high, exact)``: the value at the rank of a share lies above low and is at most high; if exact, it is high."""
    rank = max(1, math.ceil(alpha * sum(n)))
    v = np.concatenate(points)
    order = np.argsort(v, kind="stable")
    # what is known of how many values are not above a point: a task has at least those up to its last point, and at most those below its next
    sure = np.cumsum(np.concatenate([np.diff(u, prepend=0) for u in upto])[order])
    most = sum(int(b[0]) for b in below) + np.cumsum(np.concatenate([np.diff(np.r_[b, k]) for b, k in zip(below, n, strict=True)])[order])
    v = v[order]
    last = np.r_[v[1:] != v[:-1], True]
    v, sure, most = v[last], sure[last], most[last]
    high = int(np.searchsorted(sure, rank))
    low = int(np.searchsorted(most, rank)) - 1
    exact = low == high - 1 and (low < 0 or sure[low] == most[low])
    return rank, float(v[low]) if low >= 0 else -math.inf, float(v[high]), bool(exact)


def _leaf_values(data: DataFrame, residuals: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray, np.ndarray]]], alphas: list[float]) -> dict[tuple[int, int], float]:
    """By model and leaf, of the residuals the least that reaches the model's share of them, exactly.

    ``residuals`` gives ``(model, leaf, d)`` of a task's blocks. The driver receives a row a leaf.
    """

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def given(model: int) -> pa.RecordBatch:
            leaf, d = (np.concatenate(x) for x in zip(*held.pop(model), strict=True))
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in _points(model, leaf, d)], schema)

        for model, leaf, d in residuals(batches):
            held.setdefault(model, []).append((leaf, d))
            if sum(len(x) for _, x in held[model]) >= HELD:
                yield given(model)
        for model in list(held):
            yield given(model)

    names = ["model", "leaf", "n", "v", "below", "upto"]
    schema = pa.schema([("model", pa.int32()), ("leaf", pa.int32()), ("n", pa.int64()), ("v", pa.binary()), ("below", pa.binary()), ("upto", pa.binary())])
    arrays = lambda t, c, kind: [np.frombuffer(b, kind) for b in t.column(c).to_pylist()]

    def narrowed(t: pa.Table) -> pa.Table:
        model = t.column("model")[0].as_py()
        found = _between(alphas[model], t.column("n").to_pylist(), arrays(t, "v", np.float64), arrays(t, "below", np.int64), arrays(t, "upto", np.int64))
        return pa.table([pa.array([x], k) for x, k in zip((model, t.column("leaf")[0].as_py(), *found), (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()), strict=True)], ["model", "leaf", "rank", "low", "high", "exact"])

    near = data.mapInArrow(points, "model int, leaf int, n long, v binary, below binary, upto binary").groupBy("model", "leaf").applyInArrow(narrowed, "model int, leaf int, rank long, low double, high double, exact boolean").collect()
    out = {(r["model"], r["leaf"]): r["high"] for r in near}
    todo = {(r["model"], r["leaf"]): (r["rank"], r["low"], r["high"]) for r in near if not r["exact"]}
    if not todo:
        return out

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {k: [0, [], []] for k in todo}
        for model, leaf, d in residuals(batches):
            for k in np.unique(leaf).tolist():
                if (model, k) not in todo:
                    continue
                _, low, high = todo[model, k]
                own = d[leaf == k]
                v, c = np.unique(own[(own > low) & (own <= high)], return_counts=True)
                into = held[model, k]
                into[0] += int((own <= low).sum())
                into[1].append(v)
                into[2].append(c)
        made = [(m, k, b, np.concatenate(v).tobytes(), np.concatenate(c).tobytes()) for (m, k), (b, v, c) in held.items() if v]
        yield pa.RecordBatch.from_pylist([dict(zip(("model", "leaf", "below", "v", "c"), r, strict=True)) for r in made], pa.schema([("model", pa.int32()), ("leaf", pa.int32()), ("below", pa.int64()), ("v", pa.binary()), ("c", pa.binary())]))

    def chosen(t: pa.Table) -> pa.Table:
        key = t.column("model")[0].as_py(), t.column("leaf")[0].as_py()
        v, c = np.concatenate(arrays(t, "v", np.float64)), np.concatenate(arrays(t, "c", np.int64))
        order = np.argsort(v, kind="stable")
        at = np.searchsorted(sum(t.column("below").to_pylist()) + np.cumsum(c[order]), todo[key][0])
        return pa.table([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([float(v[order][at])])], ["model", "leaf", "value"])

    rows = data.mapInArrow(inside, "model int, leaf int, below long, v binary, c binary").groupBy("model", "leaf").applyInArrow(chosen, "model int, leaf int, value double").collect()
    return out | {(r["model"], r["leaf"]): r["value"] for r in rows}


def prepare(df: DataFrame, b: Binning, group: str, y: str, part: Column, keys: list[str]) -> DataFrame:
    """The stored table that all fits read: keys, group, part, target, a random number by key, and bins."""
    own = [*keys, "g", "part", "y", "u"]
    rows = df.select(
        *keys, F.col(group).cast("int").alias("g"), part.cast("int").alias("part"), F.col(y).cast("double").alias("y"), F.xxhash64(*keys).alias("u"),
        *[F.col(c).cast("double").alias(f"b_{c}") for c in b.cuts], *[F.col(c).cast("string").alias(f"b_{c}") for c in b.values],
    )
    named = Binning({f"b_{c}": v for c, v in b.cuts.items()}, {f"b_{c}": v for c, v in b.values.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], _as_bytes(_binned(batch, named).T)], [*own, "x"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return stored(rows.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in own], "x binary"])), "binned")


def fit(
    table: DataFrame, models: list[Model], n_features: int, rounds: int, patience: int | None = None, rate: float = 0.3, depth: int = 4, least: int = 20,
    share: float = 0.8, learn: tuple[int, ...] = (FIT,), fixed: dict[str, int] | None = None,
) -> list[Model]:
    """Grow all models, round by round, on the parts ``learn`` of the ``prepare``-d table.

    With ``patience`` a model stops after so many rounds without a smaller loss on the tuning part,
    and keeps its best number of trees; with ``fixed`` each grows its given number. ``rounds`` bounds
    both. Bases and leaf values are exact quantiles of the targets and residuals. Rows with a null
    target are ignored; a group without rows gives a model of value 0.
    """
    models = [replace(m, trees=[], losses=[], gain={}, done=False) for m in models]
    data, since = _pack(table, models, {*learn, *([TUNE] if patience is not None else [])}), 0
    where = {g: [i for i, m in enumerate(models) if m.group == g] for g in {m.group for m in models}}
    # models of one group and share have one base
    same: dict[tuple[int, float], int] = {}
    for i, m in enumerate(models):
        same.setdefault((m.group, m.alpha), i)

    def targets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for b in _blocks(batches):
            y = b.y[np.isin(b.part, learn)]
            for (g, _), i in same.items():
                if g == b.group and len(y):
                    yield i, np.zeros(len(y), np.uint8), y

    bases = _leaf_values(data, targets, [m.alpha for m in models])
    models = [replace(m, base=bases.get((same[m.group, m.alpha], 0), 0.0)) for m in models]
    for turn in range(rounds + 1):
        grown = [Tree(np.full((1 << depth) - 1, -1, np.int16), np.zeros((1 << depth) - 1, np.uint8), np.zeros(1 << depth)) for _ in models]
        active = [i for i, m in enumerate(models) if not m.done]
        for level in range(depth):

            def work(batches: Iterator[pa.RecordBatch], level: int = level, turn: int = turn, active: list[int] = active, grown: list[Tree] = grown, since: int = since) -> dict[int, tuple[np.ndarray, np.ndarray]]:
                out = {i: (np.zeros((1 << level, len(models[i].features), 2 * (BINS + 1)), np.int64), np.zeros(2)) for i in active}
                for b in _blocks(batches):
                    own = [(k, i) for k, i in enumerate(where[b.group]) if i in out]
                    if not own:
                        continue
                    use, tune = np.isin(b.part, learn) & _kept(b.u, turn, share), b.part == TUNE
                    for k, i in own:
                        m = models[i]
                        d = b.y - _scores(m, b.x, b.f[k], since, rate, depth)
                        if level == 0:
                            out[i][1][:] += _pinball(d[tune], m.alpha).sum(), tune.sum()
                        # rows not learned from are counted in a node of their own, which copies less than leaving them out
                        node = np.where(use, grown[i].leaves(b.x, level), np.uint8(1 << level))
                        out[i][0][:] += _counts(b.x, d > 0, node, sorted(m.features), (1 << level) + 1)[:-1]
                return out

            found = _sums(data, work)
            for i in active:
                m = models[i]
                counts, loss = found.get(i, (np.zeros((1 << level) * len(m.features) * 2 * (BINS + 1), np.int64), np.zeros(2)))
                if level == 0:
                    if patience is not None:
                        m.losses.append(float(loss[0] / max(loss[1], 1)))
                        m.done = len(m.trees) - m.best >= patience
                    m.done = m.done or len(m.trees) >= (fixed or {}).get(m.name, rounds) or turn == rounds
                if not m.done:
                    _splits(m, counts, grown[i], level, least)
            active = [i for i in active if not models[i].done]
            if not active:
                break
        if not active:
            break

        def residuals(batches: Iterator[pa.RecordBatch], turn: int = turn, active: list[int] = active, grown: list[Tree] = grown, since: int = since) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for b in _blocks(batches):
                use = np.isin(b.part, learn) & _kept(b.u, turn, share)
                for k, i in enumerate(where[b.group]):
                    if i in active and use.any():
                        yield i, grown[i].leaves(b.x, depth)[use], (b.y - _scores(models[i], b.x, b.f[k], since, rate, depth))[use]

        for (i, leaf), value in _leaf_values(data, residuals, [m.alpha for m in models]).items():
            grown[i].value[leaf] = value
        for i in active:
            models[i].trees.append(grown[i])
        if turn - since >= EVERY - 1:
            data, since = stored(data.mapInArrow(_advanced(models, where, since, rate, depth), BLOCKS), "scores"), turn + 1
            # a model that stopped has no trees beyond, so its stored scores are complete
    for m in models:
        if patience is not None:
            m.trees = m.trees[: m.best]
    return models


def _advanced(models: list[Model], where: dict[int, list[int]], since: int, rate: float, depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores with all trees so far, of the models of each block's group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            yield _packed(replace(b, f=np.stack([_scores(models[i], b.x, b.f[k], since, rate, depth) for k, i in enumerate(where[b.group])])))

    return run


def predict(table: DataFrame, models: list[Model], keys: list[str], rate: float = 0.3, depth: int = 4) -> DataFrame:
    """Keys, target and a column for each name before ``|`` of the models: of the row's group's model of that name."""
    names = list(dict.fromkeys(m.name.split("|")[0] for m in models))
    by = {(m.name.split("|")[0], m.group): m for m in models}
    fields = {f.name: f.dataType.simpleString() for f in table.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            group = batch.column("g").to_numpy()
            x = _bins_of(batch)
            out = []
            for name in names:
                p = np.full(n, np.nan)
                for g in np.unique(group):
                    m = by.get((name, int(g)))
                    if m is not None:
                        own = np.flatnonzero(group == g)
                        p[own] = _scores(m, x[:, own], None, 0, rate, depth)
                out.append(pa.array(p, from_pandas=True))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in [*keys, "y"]], *out], [*keys, "y", *names])

    form = ", ".join([*[f"{k} {fields[k]}" for k in keys], "y double", *[f"{n} double" for n in names]])
    return table.select(*keys, "y", "g", "x").mapInArrow(run, form)


def refitted(table: DataFrame, models: list[Model], n_features: int, most: int, factor: float = 1.1, **settings) -> list[Model]:
    """Fresh models on the fitted and tuning rows, each of a tenth more trees than were best (one at least)."""
    sizes = {m.name: max(1, math.ceil(factor * m.best)) for m in models}
    return fit(table, models, n_features, min(max(sizes.values()), math.ceil(factor * most)), learn=(FIT, TUNE), fixed=sizes, **settings)


def stages(spark, models: list[Model]) -> DataFrame:
    """The models as a table: a row for each node or leaf of each stage, and one of stage -1 with the base."""
    form = "name string, group int, alpha double, stage int, node int, feature int, cut int, value double"
    rows = [(m.name, m.group, m.alpha, -1, 0, None, None, m.base) for m in models]
    for m in models:
        for k, t in enumerate(m.trees):
            rows += [(m.name, m.group, m.alpha, k, i, int(f), int(c), None) for i, (f, c) in enumerate(zip(t.feature, t.cut, strict=True))]
            rows += [(m.name, m.group, m.alpha, k, len(t.feature) + i, None, None, float(v)) for i, v in enumerate(t.value)]
    return spark.createDataFrame(rows, form)


def from_stages(df: DataFrame) -> list[Model]:
    """The models of such a table, which holds as many rows as they have nodes."""
    models: dict[str, Model] = {}
    nodes: dict[tuple[str, int], list] = {}
    for r in df.orderBy("name", "stage", "node").collect():
        if r["stage"] < 0:
            models[r["name"]] = Model(r["name"], r["group"], r["alpha"], [], r["value"])
        else:
            nodes.setdefault((r["name"], r["stage"]), []).append(r)
    for (name, _), rows in nodes.items():
        inner, leaves = [r for r in rows if r["value"] is None], [r for r in rows if r["value"] is not None]
        models[name].trees.append(Tree(np.array([r["feature"] for r in inner], np.int16), np.array([r["cut"] for r in inner], np.uint8), np.array([r["value"] for r in leaves])))
    return list(models.values())
