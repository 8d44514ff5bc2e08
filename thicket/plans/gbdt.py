"""Gradient boosting: the loop over rounds, levels and leaves.

The driver holds trees and histograms, whose size depends on nodes, columns and bins alone. Each level of all outputs'
trees is one Spark job over the binned blocks: partial histograms in Arrow batches, added up in one small shuffle (or on the
driver, while all tasks' partials are few by count), and split search in numpy. Of two siblings only the smaller is counted;
the other is its parent less that, or counted too if the parent's histogram was evicted. Margins of training and validation rows
are stored with the blocks every few rounds, so a round costs the same however long the forest is.
"""

from __future__ import annotations

import heapq
import logging
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions import metrics as M
from thicket.functions import objectives as O
from thicket.operators import binning, sampling
from thicket.operators.forest import Forest, Tree
from thicket.operators.linear_leaf import LinearLeafConfig, attach, global_features, path_features, solve
from thicket.operators.split import Split, SplitParams, find, leaf_weight
from thicket.plans import kernel as K
from thicket.session import drop, materialised
from thicket.sources.dataset import ROW, Dataset

log = logging.getLogger("thicket")


@dataclass(frozen=True)
class GBDTConfig:
    objective: O.Objective = field(default_factory=O.squared)
    metric: M.Metric | None = None
    n_estimators: int = 100
    learning_rate: float = 0.3
    growth: str = "depthwise"
    max_depth: int = 6
    n_leaves: int = 31
    max_onehot_cats: int = 4
    l1: float = 0.0
    l2: float = 1.0
    min_gain_to_split: float = 0.0
    min_child_weight: float = 1.0
    min_samples_leaf: int = 1
    subsample: float = 1.0
    goss: tuple[float, float] | None = None
    colsample_bytree: float = 1.0
    colsample_bylevel: float = 1.0
    colsample_bynode: float = 1.0
    linear_leaves: LinearLeafConfig | None = None
    binning: binning.BinningConfig = field(default_factory=binning.BinningConfig)
    early_stopping_rounds: int | None = None
    seed: int = 42
    verbosity: str = "silent"
    #: rounds after which margins are written with the blocks; between, each job adds at most so many rounds' trees
    margin_rounds: int = 8
    #: bytes of margins that a worker remembers
    margin_bytes: int = 64 << 20
    #: bytes of histograms that the driver keeps
    histogram_bytes: int = 512 << 20

    def __post_init__(self):
        checks = {
            "n_estimators must be at least 1": self.n_estimators >= 1, "learning_rate must be above 0": self.learning_rate > 0, "growth must be depthwise or leafwise": self.growth in ("depthwise", "leafwise"),
            "max_depth must be at least 1": self.max_depth >= 1, "n_leaves must be at least 2": self.n_leaves >= 2, "l1 and l2 must not be negative": self.l1 >= 0 and self.l2 >= 0,
            "subsample must be in (0, 1]": 0 < self.subsample <= 1, "column samples must be in (0, 1]": all(0 < c <= 1 for c in (self.colsample_bytree, self.colsample_bylevel, self.colsample_bynode)),
            "min_samples_leaf must be at least 1": self.min_samples_leaf >= 1, "early_stopping_rounds must not be negative": (self.early_stopping_rounds or 0) >= 0,
            "margin_rounds must be at least 1": self.margin_rounds >= 1, "histogram_bytes must not be negative": self.histogram_bytes >= 0,
            "goss shares must be above 0 and together at most 1": self.goss is None or (min(self.goss) > 0 and sum(self.goss) <= 1),
        }
        for message, fine in checks.items():
            if not fine:
                raise ValueError(message)

    @property
    def split(self) -> SplitParams:
        return SplitParams(self.l1, self.l2, self.min_gain_to_split, self.min_child_weight, self.min_samples_leaf, self.max_onehot_cats)


class EarlyStopping:
    """Only a strictly better value counts; stop after `patience` rounds without one. 0 never stops."""

    def __init__(self, patience: int, higher_is_better: bool):
        self.patience, self.sign = patience, 1 if higher_is_better else -1
        self.best: float | None = None
        self.best_round = self.round = 0

    def update(self, value: float) -> str:
        self.round += 1
        if self.best is None or self.sign * (value - self.best) > 0:
            self.best, self.best_round = value, self.round
            return "improved"
        return "stop" if self.patience and self.round - self.best_round >= self.patience else "continue"


class HistogramPool(dict):
    """Histograms by (output, node), the least recently used evicted beyond `most` bytes."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.held = most, 0

    def __setitem__(self, key: tuple[int, int], hist: np.ndarray) -> None:
        self.discard(key)
        super().__setitem__(key, hist)
        self.held += hist.nbytes
        while self.held > self.most and len(self):
            self.discard(next(iter(self)))

    def use(self, key: tuple[int, int]) -> np.ndarray | None:
        hist = self.get(key)
        if hist is not None:
            self[key] = hist  # now the most recent
        return hist

    def discard(self, key: tuple[int, int]) -> None:
        hist = super().pop(key, None)
        if hist is not None:
            self.held -= hist.nbytes


def blocks_of(ds: Dataset, mappers: Sequence[binning.Mapper], raw: Sequence[str], layout: K.Layout, rows: int = 32_768, kept: list | None = None) -> DataFrame:
    """The block table (see plans.kernel), written to shared storage and held in memory. Rows with a missing target are left out; a missing weight is 1."""
    features = list(dict.fromkeys([*(m.feature for m in mappers), *raw]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, nth, held, size = TaskContext.get().partitionId(), 0, [], 0

        def cut(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            x = {f: t[f"_{f}"].to_numpy().astype(np.float64) for f in features}
            bins = np.stack([m.apply(x[m.feature]) for m in mappers]) if mappers else np.empty((0, t.num_rows), np.uint16)
            values = [np.stack([x[f] for f in raw]).tobytes() if raw else b"", t["_y"].to_numpy().astype(np.float64).tobytes(), t["_w"].to_numpy().astype(np.float64).tobytes()]
            return pa.RecordBatch.from_pydict({"block": [(pid << 32) | nth], "n": pa.array([t.num_rows], pa.int32()), "ids": [t[ROW].to_numpy().astype(np.int64).tobytes()], "bins": [layout.pack(bins.astype(np.uint16)).tobytes()], "raw": [values[0]], "y": [values[1]], "w": [values[2]], "m": [b""]})

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= rows:
                yield cut(held)
                held, size, nth = [], 0, nth + 1
        if size:
            yield cut(held)

    y = F.col(ds.label)
    w = F.coalesce(F.col(ds.weight), F.lit(1.0)) if ds.weight else F.lit(1.0)
    rows_df = ds.df.where(y.isNotNull() & ~F.isnan(y)).select(ROW, *[F.col(f).cast("double").alias(f"_{f}") for f in features], y.cast("double").alias("_y"), w.cast("double").alias("_w"))
    return materialised(rows_df.mapInArrow(run, K.BLOCK), kept).persist(StorageLevel.MEMORY_AND_DISK)


@dataclass
class Grown:
    """A growing tree with what the driver knows of its nodes."""

    tree: K.BinTree
    columns: list[int]
    sums: dict[int, tuple[float, float, float]] = field(default_factory=dict)
    splits: dict[int, Split | None] = field(default_factory=dict)
    gains: dict[int, float] = field(default_factory=dict)
    depth: dict[int, int] = field(default_factory=lambda: {0: 0})


@dataclass
class TrainResult:
    forest: Forest
    mappers: list[binning.Mapper]
    history: list[dict[str, float]]
    best_iteration: int


class Trainer:
    #: partial histogram rows of all tasks that the driver adds up itself; above, a shuffle does
    MOST_COLLECTED = 2_000_000

    def __init__(self, ds: Dataset, config: GBDTConfig, valid: Dataset | None = None):
        if not ds.label:
            raise ValueError("training needs a label")
        self.ds, self.c = ds, config
        mappers, found = binning.fit_analysed(ds, config.binning)
        self.mappers = [m for m in mappers if m.n_bins > 1]
        self.numbers = [ds.features.index(m.feature) for m in self.mappers]
        self.numeric = {i for i, m in zip(self.numbers, self.mappers, strict=True) if not m.categorical}
        self.raw = [f for i, f in enumerate(ds.features) if i in self.numeric] if config.linear_leaves else []
        self.n_bins = np.array([m.n_bins for m in self.mappers], np.int64)
        self.is_cat = np.array([m.categorical for m in self.mappers], bool)
        self.missing = np.array([m.missing_bin if m.missing else -1 for m in self.mappers], np.int32)
        self.width = int(self.n_bins.max()) if len(self.n_bins) else 1
        # a missing value is set beside other columns, so columns with missing values stay alone
        whole = {a.feature for a in found if not a.n_missing}
        place = {m.feature: i for i, m in enumerate(self.mappers) if m.feature in whole}
        self.bundles = [b for b in ([place[f] for f in b if f in place] for b in binning.bundle_plan(ds, config.binning, found=found)) if 1 < len(b) and 1 + int(self.n_bins[b].sum()) < 65536]
        layout = K.layout_of(self.n_bins, self.bundles, [int(m.apply(np.zeros(1))[0]) for m in self.mappers])
        self.kept: dict[str, list[str]] = {"train": [], "valid": []}
        self.blocks = {"train": blocks_of(ds, self.mappers, self.raw, layout, kept=self.kept["train"])}
        if valid is not None:
            self.blocks["valid"] = blocks_of(valid, self.mappers, self.raw, layout, kept=self.kept["valid"])
        self.tasks = self.blocks["train"].rdd.getNumPartitions()
        self.base = config.objective.base(ds.df.where(F.col(ds.label).isNotNull()), ds.label, ds.weight)
        self.state = K.State(uuid.uuid4().hex, [], self.base, self.missing, config.objective.kernel, layout, len(self.raw), config.margin_bytes, config.subsample, seed=config.seed)
        self.pool = HistogramPool(config.histogram_bytes)
        self.made: list[Tree] = []

    def close(self) -> None:
        for name, blocks in self.blocks.items():
            blocks.unpersist()
            for path in self.kept[name]:
                drop(blocks.sparkSession, path)

    def of(self, name: str) -> K.State:
        """The state as jobs over these blocks know it: block numbers are the tables' own."""
        return self.state if name == "train" else replace(self.state, run=f"{self.state.run} {name}", goss=None, subsample=1.0)

    def settle(self) -> None:
        """Writes all finished trees into the blocks' margins; the state's trees start anew."""
        for name, old in self.blocks.items():
            state = self.of(name)
            new = materialised(old.mapInArrow(K.settle_job(state), K.BLOCK), self.kept[name]).persist(StorageLevel.MEMORY_AND_DISK)
            new.count()
            old.unpersist()
            drop(old.sparkSession, self.kept[name].pop(0))
            self.blocks[name] = new
        self.state = replace(self.state, run=uuid.uuid4().hex, trees=[])

    def evaluate(self, name: str, metric: M.Metric) -> float:
        """The metric over the stored margins and the trees since."""
        state = self.of(name)
        transform = self.c.objective.applied_np if metric.kind != "margin" else None
        ps = [f"p{k}" for k in range(len(self.base))]
        rows = self.blocks[name].select(*dict.fromkeys(state.columns)).mapInArrow(K.outputs_job(state, transform), K.outputs_schema(len(ps)))
        return metric.evaluate(rows, ps, "y", "w")

    # one job

    def _job(self, function: Callable, schema: str) -> DataFrame:
        return self.blocks["train"].select(*self.state.columns).mapInArrow(function, schema)

    def histograms(self, growing: dict[int, Grown], wanted: dict[int, list[int]]) -> None:
        """Counts the wanted nodes of each output, searches their splits, and keeps what the pool has room for. Many nodes take several jobs."""
        size = self.state.layout.height * self.state.layout.width * 24
        nodes = [(k, n) for k, v in wanted.items() for n in v]
        most = max(1, (256 << 20) // max(size, 1))
        for a in range(0, len(nodes), most):
            part: dict[int, list[int]] = {}
            for k, n in nodes[a : a + most]:
                part.setdefault(k, []).append(n)
            for k, n, hist in self.counted(growing, part):
                self.keep(growing[k], k, n, hist)

    def counted(self, growing: dict[int, Grown], wanted: dict[int, list[int]]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(output, node, [columns, bins, 3] sums of g, h and rows)."""
        layout = self.state.layout
        partial = self._job(K.histogram_job(self.state, {k: growing[k].tree for k in wanted}, wanted), K.HISTOGRAM)
        if self.tasks * sum(len(v) for v in wanted.values()) * layout.height * layout.width > self.MOST_COLLECTED:
            partial = partial.groupBy("output", "slot", "row", "code").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
        rows = partial.toArrow()
        out, slot, f, b, *values = (rows[c].to_numpy() for c in ("output", "slot", "row", "code", "g", "h", "n"))
        for k, nodes in wanted.items():
            own = out == k
            shape = (len(nodes), layout.height, layout.width)
            at = np.ravel_multi_index((slot[own], f[own], b[own]), shape) if own.any() else np.empty(0, np.int64)
            x = np.stack([np.bincount(at, v[own], int(np.prod(shape))) for v in values], axis=1).reshape(*shape, 3)
            for i, node in enumerate(nodes):
                grown = growing[k]
                if node not in grown.sums:
                    # the root: every row has one code in each stored row
                    grown.sums[node] = tuple(x[i][0].sum(axis=0))
                yield k, node, layout.unpack(x[i], np.array(grown.sums[node]), self.width)

    def keep(self, grown: Grown, k: int, node: int, hist: np.ndarray) -> None:
        self.search(grown, node, hist)
        self.pool[k, node] = hist

    # one round

    def start(self, outputs: Sequence[int]) -> dict[int, Grown]:
        r = self.state.round
        everyone = list(range(len(self.mappers)))
        growing = {k: Grown(K.BinTree(group=k), sampling.columns(everyone, self.c.colsample_bytree, self.c.seed, r, k)) for k in outputs}
        if self.c.goss:
            self.state.goss = self.goss_bounds()
        if self.mappers:
            self.histograms(growing, {k: [0] for k in outputs})
        else:
            # no column to take the sums from
            rows = self._job(K.sums_job(self.state, outputs), "output int, g double, h double, n double").groupBy("output").agg(F.sum("g"), F.sum("h"), F.sum("n")).collect()
            got = {r[0]: tuple(r[1:]) for r in rows}
            for k, grown in growing.items():
                grown.sums[0], grown.splits[0] = got.get(k, (0.0, 0.0, 0.0)), None
        return growing

    def goss_bounds(self) -> tuple[float, float, float] | None:
        """(least magnitude that is always in, share of the others, their scale); none in the warm-up of floor(1 / learning rate) rounds.

        The least magnitude is the k-th greatest itself: four passes of counts, each over 16 more bits of those that agree so far.
        """
        top, other = self.c.goss
        if self.state.round < int(1 / self.c.learning_rate):
            return None
        self.state.goss = None
        prefix = above = n = k = 0
        for shift in (48, 32, 16, 0):
            cells = sorted((r[0], r[1]) for r in self._job(K.magnitude_job(self.state, prefix, shift), "cell int, n long").groupBy("cell").agg(F.sum("n")).collect())
            if shift == 48:
                n = sum(x for _, x in cells)
                k = max(1, int(n * top))
            for cell, x in reversed(cells):
                if above + x >= k or cell == cells[0][0]:
                    prefix = prefix << 16 | cell
                    above += x if shift == 0 else 0
                    break
                above += x
        rest = n - above
        share = min(1.0, max(1, int(n * other)) / rest) if rest else 0.0
        scale = (n - k) / (rest * share) if rest and share else 1.0
        return float(np.array([prefix], np.uint64).view(np.float64)[0]), share, scale

    def search(self, grown: Grown, node: int, hist: np.ndarray) -> None:
        """The node's best split, or none, by its histogram; remembered."""
        columns = grown.columns
        if self.c.colsample_bylevel < 1:
            columns = sampling.columns(columns, self.c.colsample_bylevel, self.c.seed, self.state.round, grown.tree.group, "level", grown.depth[node])
        if self.c.colsample_bynode < 1:
            columns = sampling.columns(columns, self.c.colsample_bynode, self.c.seed, self.state.round, grown.tree.group, "node", node)
        s = find(hist, np.array(grown.sums[node]), self.n_bins, self.is_cat, self.missing >= 0, self.c.split, np.array(columns, np.int64))
        grown.splits[node] = s if s and s.gain > self.c.min_gain_to_split else None

    def apply(self, grown: Grown, node: int) -> tuple[int, int, int]:
        """Splits the node; (smaller child, larger child, node)."""
        s = grown.splits[node]
        a, b = grown.tree.split(node, s.feature, s.bin, s.default_left, s.left_cats)
        grown.sums[a], grown.sums[b], grown.gains[node] = s.left, s.right, s.gain
        grown.depth[a] = grown.depth[b] = grown.depth[node] + 1
        return (a, b, node) if s.left[2] <= s.right[2] else (b, a, node)

    def count(self, growing: dict[int, Grown], made: dict[int, list[tuple[int, int, int]]]) -> None:
        """Histograms and splits of new children: the smaller from the data, the larger by subtraction, or from the data where the parent's is gone."""
        parents = {(k, m[2]): self.pool.use((k, m[2])) for k, v in made.items() for m in v}
        self.histograms(growing, {k: [c for m in v for c in ((m[0],) if parents[k, m[2]] is not None else m[:2])] for k, v in made.items() if v})
        lost: dict[int, list[int]] = {}
        for k, v in made.items():
            for small, large, parent in v:
                hist, own = parents[k, parent], self.pool.use((k, small))
                if hist is None:
                    continue
                if own is None:
                    lost.setdefault(k, []).append(large)
                    continue
                self.pool.discard((k, parent))
                self.keep(growing[k], k, large, hist - own)
        if lost:
            self.histograms(growing, lost)

    def grow_depthwise(self, growing: dict[int, Grown]) -> None:
        level = {k: [0] for k in growing}
        for depth in range(self.c.max_depth):
            made = {k: [self.apply(growing[k], n) for n in nodes if growing[k].splits.get(n)] for k, nodes in level.items()}
            if not any(made.values()):
                break
            if depth + 1 < self.c.max_depth:
                self.count(growing, made)
            level = {k: sorted(c for m in v for c in m[:2]) for k, v in made.items()}

    def grow_leafwise(self, growing: dict[int, Grown]) -> None:
        """The greatest gain first; of equal gains the larger node number. Each turn adds one leaf to the count, also if nothing splits."""
        heaps: dict[int, list] = {k: [] for k in growing}
        leaves = dict.fromkeys(growing, 1)

        def push(k: int, node: int) -> None:
            s = growing[k].splits.get(node)
            if s:
                heapq.heappush(heaps[k], (-s.gain, -node))

        for k in growing:
            push(k, 0)
        while any(heaps[k] and leaves[k] < self.c.n_leaves for k in growing):
            made = {}
            for k in growing:
                if heaps[k] and leaves[k] < self.c.n_leaves:
                    made[k] = [self.apply(growing[k], -heapq.heappop(heaps[k])[1])]
                    leaves[k] += 1
            self.count(growing, {k: v for k, v in made.items() if leaves[k] < self.c.n_leaves})
            for k, v in made.items():
                if leaves[k] < self.c.n_leaves:
                    for child in v[0][:2]:
                        push(k, child)

    def renew(self, growing: dict[int, Grown], cells: int = 4096) -> None:
        """Leaves become lower weighted quantiles of their residuals, found by zooming into counts until a cell holds one value."""
        trees = {k: g.tree for k, g in growing.items()}

        def by_cell(ranges: dict | None) -> list:
            job = self._job(K.residual_job(self.state, trees, ranges, cells), K.RESIDUALS)
            return job.groupBy("output", "leaf", "cell").agg(F.sum("w"), F.min("low"), F.max("top")).collect()

        goals: dict[tuple[int, int], float] = {}
        ranges: dict[tuple[int, int], tuple[float, float]] = {}
        for k, n, _, w, low, top in by_cell(None):
            goals[k, n], ranges[k, n] = self.c.objective.renew[k] * w, (low, top)
        open_ = {key: r for key, r in ranges.items() if r[0] < r[1]}
        while open_:
            found: dict[tuple[int, int], list] = {}
            for k, n, cell, w, low, top in by_cell(open_):
                found.setdefault((k, n), []).append((cell, w, low, top))
            for key, rows in found.items():
                total = 0.0
                rows.sort()
                for cell, w, low, top in rows:
                    total += w
                    if cell >= 0 and (total >= goals[key] * (1 - 1e-12) or cell == rows[-1][0]):
                        # a cell that holds all of its range cannot be cut any further
                        ranges[key] = (low, top) if (low, top) != ranges[key] else (top, top)
                        break
            open_ = {key: ranges[key] for key in open_ if ranges[key][0] < ranges[key][1]}
        for (k, n), (_, value) in ranges.items():
            growing[k].tree.value[n] = value * self.c.learning_rate

    def linear(self, growing: dict[int, Grown]) -> None:
        c = self.c.linear_leaves
        columns = {self.numbers.index(i): j for j, i in enumerate(sorted(self.numeric))}  # matrix column -> raw column
        chosen: dict[tuple[int, int], list[int]] = {}
        for k, g in growing.items():
            shape = Tree(feature=g.tree.feature, left=g.tree.left, right=g.tree.right, left_cats=g.tree.cats)
            for leaf in shape.leaves:
                if g.sums[leaf][2] >= c.min_samples:
                    fs = path_features(shape, leaf, set(columns), c.max_features) if c.scope == "path" else global_features(shape, set(columns), c.max_features)
                    if fs:
                        chosen[k, leaf] = [columns[f] for f in fs]
        if not chosen:
            return
        rows = self._job(K.moments_job(self.state, {k: g.tree for k, g in growing.items()}, chosen), K.MOMENTS).groupBy("output", "leaf", "i").agg(F.sum("v")).collect()
        sums = {key: np.zeros((len(fs) + 3, len(fs) + 1)) for key, fs in chosen.items()}
        for k, leaf, i, v in rows:
            sums[k, leaf].ravel()[i] = v
        for (k, leaf), fs in chosen.items():
            if (got := solve(sums[k, leaf], c)) is not None:
                attach(growing[k].tree, leaf, fs, got, self.c.learning_rate, c)

    def round(self) -> None:
        growing = self.start(range(self.c.objective.n_outputs))
        (self.grow_depthwise if self.c.growth == "depthwise" else self.grow_leafwise)(growing)
        for g in growing.values():
            for i, f in enumerate(g.tree.feature):
                if f < 0:
                    g.tree.value[i] = self.c.learning_rate * leaf_weight(g.sums[i][0], g.sums[i][1], self.c.split)
        if self.c.objective.renew:
            self.renew(growing)
        elif self.c.linear_leaves and self.state.round >= self.c.linear_leaves.skip_first:
            self.linear(growing)
        self.state.trees = [*self.state.trees, *(growing[k].tree for k in sorted(growing))]
        self.state.round += 1
        self.made += [self.finished(growing[k]) for k in sorted(growing)]
        self.pool.clear()
        self.pool.held = 0
        if self.state.round % self.c.margin_rounds == 0 and self.state.round < self.c.n_estimators:
            self.settle()

    def finished(self, grown: Grown) -> Tree:
        def threshold(f: int, b: int) -> float:
            bound = self.mappers[f].bounds[b]
            # inference tests x < threshold, training x <= bound
            return float("inf") if bound >= binning.BIG else float(np.nextafter(bound, np.inf))

        t = K.tree_of(grown.tree, threshold, self.numbers)
        raw = sorted(self.numeric)
        t.lin = {k: ([raw[f] for f in fs], cs, c) for k, (fs, cs, c) in grown.tree.lin.items()}
        for i in range(t.n_nodes):
            t.gain[i], t.cover[i] = grown.gains.get(i, 0.0) if t.feature[i] >= 0 else 0.0, float(grown.sums[i][1])
        return t


def train(ds: Dataset, config: GBDTConfig = GBDTConfig(), valid: Dataset | None = None) -> TrainResult:
    """A forest, with the metric's history as train-<name> and valid-<name>. With early stopping the best round's trees are kept."""
    if config.early_stopping_rounds and config.metric is None:
        raise ValueError("early stopping needs a metric")
    trainer = Trainer(ds, config, valid if config.metric else None)
    history: list[dict[str, float]] = []
    stop = EarlyStopping(config.early_stopping_rounds or 0, config.metric.higher_is_better if config.metric else False)
    try:
        for r in range(config.n_estimators):
            trainer.round()
            if config.metric:
                row = {f"{name}-{config.metric.name}": trainer.evaluate(name, config.metric) for name in trainer.blocks}
                history.append(row)
                if config.verbosity != "silent":
                    log.info("round %d: %s", r, row)
                if stop.update(row.get(f"valid-{config.metric.name}", row[f"train-{config.metric.name}"])) == "stop":
                    break
    finally:
        trainer.close()
    trees, best = trainer.made, config.n_estimators
    if config.early_stopping_rounds:
        best = stop.best_round
        trees = trees[: best * config.objective.n_outputs]
    return TrainResult(Forest(trees, trainer.base), trainer.mappers, history, min(best, trainer.state.round))
