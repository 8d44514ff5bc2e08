"""What runs inside Arrow batches while a forest grows.

The binned training set is a table of blocks: a few thousand rows each, every column one binary value, so that a batch is
numpy arrays without a copy. A block carries its rows' margins after the trees up to some round; the few trees since are added
where the block is read. A worker remembers what it has added, in bounded memory; whatever it forgets, or a lost worker knew,
costs those few trees again, however long the forest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from thicket.operators.forest import Tree
from thicket.operators.sampling import hash01

_margins: dict[tuple[str, int], tuple[int, np.ndarray]] = {}
_held = 0
BLOCK = "block long, n int, ids binary, bins binary, raw binary, y binary, w binary, m binary"


@dataclass
class Layout:
    """How columns lie in the stored matrix. A column alone is a row of it; those of a bundle share one: code 0 is the zero bin of all, others lie at `low`."""

    row: np.ndarray
    low: np.ndarray
    n_bins: np.ndarray
    zero: np.ndarray
    bundled: np.ndarray

    @property
    def height(self) -> int:
        return int(self.row.max()) + 1 if len(self.row) else 0

    @property
    def width(self) -> int:
        """Codes of the widest stored row."""
        return int((self.low + self.n_bins).max()) if len(self.row) else 1

    def take(self, stored: np.ndarray, f: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The bins of column f[i] in row rows[i]."""
        code = stored[self.row[f], rows].astype(np.int32)
        if not self.bundled.any():
            return code
        inside = (code >= self.low[f]) & (code < self.low[f] + self.n_bins[f])
        return np.where(self.bundled[f], np.where(inside, code - self.low[f], self.zero[f]), code)

    def pack(self, bins: np.ndarray) -> np.ndarray:
        """The stored matrix of a [columns, rows] matrix of bins. Of a bundle's columns the first that is not at its zero bin is kept."""
        if not self.bundled.any():
            return bins
        out = np.zeros((self.height, bins.shape[1]), np.uint16)
        for f in range(len(self.row) - 1, -1, -1):
            if self.bundled[f]:
                is_set = bins[f] != self.zero[f]
                out[self.row[f], is_set] = bins[f, is_set] + self.low[f]
            else:
                out[self.row[f]] = bins[f]
        return out

    def unpack(self, hist: np.ndarray, total: np.ndarray, width: int) -> np.ndarray:
        """[columns, width, 3] histograms from those of stored rows: a bundled column's zero bin is the node's total less its other bins."""
        if not self.bundled.any():
            return hist[:, :width]
        out = np.zeros((len(self.row), width, 3))
        for f in range(len(self.row)):
            n = int(self.n_bins[f])
            if not self.bundled[f]:
                out[f, :n] = hist[self.row[f], :n]
                continue
            out[f, :n] = hist[self.row[f], self.low[f] : self.low[f] + n]
            out[f, self.zero[f]] = 0
            out[f, self.zero[f]] = total - out[f].sum(axis=0)
        return out


def layout_of(n_bins: np.ndarray, bundles: Sequence[Sequence[int]] = (), zero: Sequence[int] = ()) -> Layout:
    """bundles: groups of columns that share a row; zero: each column's bin of the value 0."""
    n = len(n_bins)
    row, low, bundled = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    inside = {f for b in bundles for f in b}
    at = 0
    for f in range(n):
        if f not in inside:
            row[f], at = at, at + 1
    for b in bundles:
        code = 1
        for f in b:
            row[f], low[f], bundled[f] = at, code, True
            code += int(n_bins[f])
        at += 1
    return Layout(row, low, np.asarray(n_bins, np.int64), np.array(zero if len(zero) else [0] * n, np.int64), bundled)


@dataclass
class BinTree:
    """A tree over bins. feature: column of the bin matrix; bin: greatest that goes left; cats: left bins of categorical nodes; lin as in Tree."""

    group: int = 0
    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    default_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    cats: dict[int, tuple[int, ...]] = field(default_factory=dict)
    lin: dict[int, tuple[list[int], list[float], float]] = field(default_factory=dict)

    def split(self, node: int, feature: int, bin_: int, default_left: bool, cats: Sequence[int] | None) -> tuple[int, int]:
        a = len(self.feature)
        for column, v in ((self.feature, -1), (self.bin, 0), (self.default_left, False), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            column.extend([v, v])
        self.feature[node], self.bin[node], self.default_left[node], self.left[node], self.right[node] = feature, bin_, default_left, a, a + 1
        if cats is not None:
            self.cats[node] = tuple(cats)
        return a, a + 1

    def route(self, bins: np.ndarray, missing: np.ndarray, layout: Layout) -> np.ndarray:
        """The leaf of each row; bins as the layout stores them, missing[column] its missing bin or -1."""
        n = bins.shape[1]
        node = np.zeros(n, np.int32)
        if self.feature[0] < 0:
            return node
        feature, cut, default, left, right = (np.array(x) for x in (self.feature, self.bin, self.default_left, self.left, self.right))
        rows = np.arange(n)
        while len(rows):
            at = node[rows]
            f = feature[at]
            b = layout.take(bins, f, rows)
            goes = b <= cut[at]
            for k in self.cats:
                own = at == k
                if own.any():
                    goes[own] = np.isin(b[own], self.cats[k])
            goes = np.where(b == missing[f], default[at], goes)
            node[rows] = np.where(goes, left[at], right[at])
            rows = rows[feature[node[rows]] >= 0]
        return node

    def predict(self, bins: np.ndarray, missing: np.ndarray, layout: Layout, raw: np.ndarray | None) -> np.ndarray:
        leaf = self.route(bins, missing, layout)
        out = np.array(self.value)[leaf]
        for k, (features, coefs, intercept) in self.lin.items():
            own = np.flatnonzero(leaf == k)
            part = raw[np.ix_(features, own)]
            fine = ~np.isnan(part).any(axis=0)
            out[own[fine]] = intercept + np.array(coefs) @ part[:, fine]
        return out


@dataclass
class State:
    """What a job needs: the run's name, the finished trees that are not in the blocks' margins, base margins, gradients, and for GOSS and samples the round."""

    run: str
    trees: list[BinTree]
    base: list[float]
    missing: np.ndarray
    kernel: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    layout: Layout
    n_raw: int = 0
    memory: int = 64 << 20
    subsample: float = 1.0
    goss: tuple[float, float, float] | None = None
    seed: int = 0
    round: int = 0

    @property
    def columns(self) -> list[str]:
        """The block columns that gradients need."""
        drawn = ["ids"] if self.goss or self.subsample < 1 else []
        return ["block", "n", "bins", "y", "w", "m", *drawn, *(["raw"] if self.n_raw else [])]


@dataclass
class Block:
    block: int
    n: int
    bins: np.ndarray
    y: np.ndarray
    w: np.ndarray
    m: np.ndarray
    raw: np.ndarray | None
    ids: np.ndarray


def blocks(batch: pa.RecordBatch, state: State) -> Iterator[Block]:
    """The batch's blocks, their arrays in place."""
    names = set(batch.schema.names)
    for i in range(batch.num_rows):
        n = batch.column("n")[i].as_py()

        def array(name: str, kind: type, i: int = i) -> np.ndarray:
            return np.frombuffer(batch.column(name)[i].as_buffer(), kind) if name in names else np.empty(0, kind)

        bins, m = array("bins", np.uint16).reshape(state.layout.height, n), array("m", np.float64)
        raw = array("raw", np.float64).reshape(state.n_raw, n) if state.n_raw else None
        yield Block(batch.column("block")[i].as_py(), n, bins, array("y", np.float64), array("w", np.float64), m.reshape(-1, n) if len(m) else m, raw, array("ids", np.int64))


def margins(state: State, b: Block) -> np.ndarray:
    """[groups, rows] after all trees.

    What is remembered are sums of trees that the blocks do not have yet, of one run at a time for training and validation
    rows: margins without such trees are the block's own, a view of its batch that must not keep the batch alive. When the
    memory is full, blocks that are not in it are added anew each time; evicting for them would lose every block before its turn.
    """
    global _held
    if not state.trees:
        return b.m if len(b.m) else np.repeat(np.array(state.base)[:, None], b.n, axis=1)
    run = state.run.split()[0]
    for old in [k for k in _margins if k[0].split()[0] != run]:
        _held -= _margins.pop(old)[1].nbytes
    key = (state.run, b.block)
    done, m = _margins.pop(key, (0, None))
    if m is not None:
        _held -= m.nbytes
    if m is None or done > len(state.trees):
        done, m = 0, b.m if len(b.m) else np.repeat(np.array(state.base)[:, None], b.n, axis=1)
    if done < len(state.trees):
        m = m.copy()
        for t in state.trees[done:]:
            m[t.group] += t.predict(b.bins, state.missing, state.layout, b.raw)
    if _held + m.nbytes <= state.memory:
        _margins[key] = (len(state.trees), m)
        _held += m.nbytes
    return m


def gradients(state: State, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(g, h, in the sample) by output."""
    g, h = state.kernel(margins(state, b), b.y, b.w)
    g, h = np.array(g, np.float64), np.array(h, np.float64)
    inside = np.ones(g.shape, bool)
    if state.goss:
        least, share, scale = state.goss
        small = np.abs(g * h).max(axis=0) < least
        drawn = hash01(b.ids, state.seed, state.round) < share
        inside = np.broadcast_to(~small | drawn, g.shape)
        g, h = np.where(small, g * scale, g), np.where(small, h * scale, h)
    elif state.subsample < 1:
        inside = np.broadcast_to(hash01(b.ids, state.seed, state.round) < state.subsample, g.shape)
    return g, h, inside


def settle_job(state: State) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks whose margins hold all finished trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, b in enumerate(blocks(batch, state)):
                made = pa.array([margins(state, b).tobytes()], pa.binary())
                yield batch.slice(i, 1).set_column(batch.schema.get_field_index("m"), "m", made)

    return run


def outputs_job(state: State, transform: Callable[[np.ndarray], np.ndarray] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (p0, p1, ..., y, w): margins or their transform."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, state):
                p = margins(state, b)
                p = transform(p) if transform else p
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in p), pa.array(b.y), pa.array(b.w)], [*(f"p{k}" for k in range(len(p))), "y", "w"])

    return run


def outputs_schema(groups: int) -> str:
    return ", ".join([*(f"p{k} double" for k in range(groups)), "y double, w double"])


def histogram_job(state: State, growing: dict[int, BinTree], wanted: dict[int, list[int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(output, slot, row, code, g, h, n) partial sums of a task over the stored matrix, for the wanted nodes of each output's growing tree."""
    n_columns, n_bins = state.layout.height, state.layout.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros((len(nodes), n_columns, n_bins, 3)) for k, nodes in wanted.items()}
        for batch in batches:
            for b in blocks(batch, state):
                bins = b.bins
                g, h, inside = gradients(state, b)
                for k, nodes in wanted.items():
                    leaf = growing[k].route(bins, state.missing, state.layout)
                    slot_of = np.full(len(growing[k].feature), -1)
                    slot_of[nodes] = np.arange(len(nodes))
                    slot = slot_of[leaf]
                    rows = np.flatnonzero((slot >= 0) & inside[k])
                    s, gk, hk = slot[rows] * n_bins, g[k][rows], h[k][rows]
                    size = len(nodes) * n_bins
                    for f in range(n_columns):
                        at = s + bins[f, rows]
                        out = sums[k][:, f]
                        out[..., 0] += np.bincount(at, gk, size).reshape(-1, n_bins)
                        out[..., 1] += np.bincount(at, hk, size).reshape(-1, n_bins)
                        out[..., 2] += np.bincount(at, minlength=size).reshape(-1, n_bins)
        for k, x in sums.items():
            slot, f, b = np.nonzero(x[..., 2])
            for a in range(0, len(slot), 65536):
                i = (slot[a : a + 65536], f[a : a + 65536], b[a : a + 65536])
                v = x[i]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), *(pa.array(c.astype(np.int32)) for c in i), *(pa.array(v[:, j]) for j in range(3))], ["output", "slot", "row", "code", "g", "h", "n"])

    return run


HISTOGRAM = "output int, slot int, row int, code int, g double, h double, n double"


def residual_job(state: State, growing: dict[int, BinTree], ranges: dict[tuple[int, int], tuple[float, float]] | None, cells: int) -> Callable:
    """(output, leaf, cell, w, low, top): weight, least and greatest residual by cell of each leaf's range; cell -1 is the weight below it. Without ranges one cell holds all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, state):
                m = margins(state, b)
                for k, tree in growing.items():
                    leaf, r = tree.route(b.bins, state.missing, state.layout), b.y - m[k]
                    for node in np.unique(leaf):
                        if ranges is not None and (k, int(node)) not in ranges:
                            continue
                        own = leaf == node
                        v, weight = r[own], b.w[own]
                        if ranges is None:
                            out = ([0], [float(weight.sum())], [float(v.min())], [float(v.max())])
                        else:
                            low, high = ranges[k, int(node)]
                            inside = (v >= low) & (v <= high)
                            below = float(weight[v < low].sum())
                            cell = np.minimum(((v[inside] - low) / max(high - low, 1e-300) * cells).astype(np.int64), cells - 1)
                            total = np.bincount(cell, weight[inside], cells)
                            least, top = np.full(cells, np.inf), np.full(cells, -np.inf)
                            np.minimum.at(least, cell, v[inside])
                            np.maximum.at(top, cell, v[inside])
                            at = np.flatnonzero(np.isfinite(top))
                            out = ([-1, *at.tolist()], [below, *total[at].tolist()], [np.inf, *least[at].tolist()], [-np.inf, *top[at].tolist()])
                        n = len(out[0])
                        yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int32()), pa.array([int(node)] * n, pa.int32()), pa.array(out[0], pa.int32()), *(pa.array(c, pa.float64()) for c in out[1:])], ["output", "leaf", "cell", "w", "low", "top"])

    return run


RESIDUALS = "output int, leaf int, cell int, w double, low double, top double"


def moments_job(state: State, growing: dict[int, BinTree], features: dict[tuple[int, int], list[int]]) -> Callable:
    """(output, leaf, i, v): the sums of operators.linear_leaf.moments, flat, for each leaf with features (numbers of raw columns)."""
    from thicket.operators.linear_leaf import moments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for b in blocks(batch, state):
                g, h, inside = gradients(state, b)
                for k, tree in growing.items():
                    leaf = np.where(inside[k], tree.route(b.bins, state.missing, state.layout), -1)
                    for node in np.unique(leaf[leaf >= 0]):
                        own = np.flatnonzero(leaf == node)
                        if fs := features.get((k, int(node))):
                            got = moments(b.raw[np.ix_(fs, own)].T, g[k][own], h[k][own])
                            sums[k, int(node)] = sums.get((k, int(node)), 0) + got
        for (k, node), x in sums.items():
            v = x.ravel()
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(v), pa.int32()), pa.array([node] * len(v), pa.int32()), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["output", "leaf", "i", "v"])

    return run


MOMENTS = "output int, leaf int, i int, v double"


def magnitude_job(state: State, prefix: int, shift: int) -> Callable:
    """(cell, n): rows by 16 bits, at `shift`, of |g h| as a number, which orders as they do, the greatest over outputs; of those whose higher bits are the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for b in blocks(batch, state):
                g, h = state.kernel(margins(state, b), b.y, b.w)
                size = np.ascontiguousarray(np.abs(np.array(g, np.float64) * h).max(axis=0)).view(np.uint64)
                if shift < 48:
                    size = size[size >> np.uint64(shift + 16) == np.uint64(prefix)]
                counts += np.bincount((size >> np.uint64(shift) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["cell", "n"])

    return run


def sums_job(state: State, outputs: Sequence[int]) -> Callable:
    """(output, g, h, n) over all rows in the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, state):
                g, h, inside = gradients(state, b)
                rows = [(k, float(g[k][inside[k]].sum()), float(h[k][inside[k]].sum()), float(inside[k].sum())) for k in outputs]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.float64(), pa.float64(), pa.float64()), strict=True)], ["output", "g", "h", "n"])

    return run


def tree_of(t: BinTree, thresholds: Callable[[int, int], float], numbers: Sequence[int]) -> Tree:
    """The tree over raw values: numeric cuts become thresholds, columns their features' numbers; category bins are codes."""
    out = Tree(group=t.group)
    for i, f in enumerate(t.feature):
        out.add(t.value[i])
        if f >= 0:
            out.feature[i], out.left[i], out.right[i], out.default_left[i] = numbers[f], t.left[i], t.right[i], t.default_left[i]
            if i in t.cats:
                out.left_cats[i] = t.cats[i]
            else:
                out.threshold[i] = thresholds(f, t.bin[i])
    return out
