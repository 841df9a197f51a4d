"""Logistic regressions of many runs, fitted side by side with their vectors kept in Spark.

The rows of a run are dealt into blocks of a bounded number of entries, its coefficients into pieces of a
bounded number of columns.  A step is one job: pieces send each block the coefficients of its own columns, blocks send back
loss and gradient, and the pieces report scalar products.  From these alone the driver takes the step of a limited-memory
BFGS, every run for itself: what it receives grows with the runs and pieces, not with rows or vocabulary.

What a step leaves is one point (coefficients and gradient), checkpointed; steps and turns are differences of the last points.
Its shuffles are dropped as soon as it has ended, so disk holds the messages of one step, however many there are.

Columns are centred (the intercept takes up the shift) and scaled by their curvature at the start, so rare and common
terms converge alike.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharewise.plans import store
from sharewise.plans.state import checkpoint_root, delete_folder

#: Entries of a block of rows; an entry takes 16 bytes.
BLOCK_ENTRIES = 1 << 20

#: Entries of a block that all runs share, at most: fewer and larger ones send fewer coefficients.
SHARED_ENTRIES = 8 << 20

#: Pairs of steps and gradient changes that a direction is made of.
MEMORY = 8

#: Length of the scaled gradient at which a run has converged; the penalty has curvature 1.
TOLERANCE = 1e-5

#: Evaluations after which a run that has not converged is an error.
MOST_STEPS = 1000

#: Least curvature of a row that the scales reckon with.
LEAST_CURVATURE = 0.02


@dataclass
class _Plan:
    """Where rows and columns of the runs lie; one entry per run."""

    runs: list[int]
    widths: list[int]  #: columns, the intercept being the last
    blocks: list[int]  #: one entry alone where all runs share the blocks
    shared: bool  #: a run takes all rows but those that are held for it
    classes: list[float]  #: what the weight of a positive row is multiplied by where blocks are shared
    C: list[float]
    weight: list[float]
    squares: list[float]  #: sum of squared weights
    positive: list[float]
    rows: list[int]
    piece: int  #: columns of a piece
    dense: float  #: columns with a value in at least this share of the rows are centred
    standardized: bool  #: the penalty is on coefficients times the deviation of their column
    block_at: list[int] = field(init=False)
    piece_at: list[int] = field(init=False)

    def __post_init__(self):
        self.block_at = [0, *accumulate(self.blocks)]
        self.piece_at = [0, *accumulate(-(-w // self.piece) for w in self.widths)]

    def runs_of_block(self, block: int) -> range:
        if self.shared:
            return range(len(self.runs))
        r = bisect_right(self.block_at, block) - 1
        return range(r, r + 1)

    def weights(self, run: int, label: np.ndarray, weight: np.ndarray, held: np.ndarray) -> np.ndarray:
        """The weights of a block's rows in a run."""
        if not self.shared:
            return weight
        return np.where(held != self.runs[run], weight * np.where(label == 1, self.classes[run], 1.0), 0.0)

    def run_of_piece(self, piece: int) -> int:
        return bisect_right(self.piece_at, piece) - 1

    def start(self, piece: int) -> int:
        return (piece - self.piece_at[self.run_of_piece(piece)]) * self.piece

    def prior(self, run: int) -> float:
        return self.positive[run] / self.weight[run]

    def one_class(self, run: int) -> bool:
        return not 0 < self.positive[run] < self.weight[run]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of every batch by block, as flat arrays; ``at`` puts the parts of a block in order."""
    for batch in batches:
        to, at = (batch.column(c).to_numpy() for c in ("block", "at"))
        for block in np.unique(to):
            rows = batch.filter(pa.array(to == block))
            entries = rows.column("entries")
            idx, value = (pa.compute.struct_field(entries.flatten(), i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lengths = pa.compute.fill_null(pa.compute.list_value_length(entries), 0).to_numpy(zero_copy_only=False)
            label, weight, held = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("label", "weight", "held"))
            data = pickle.dumps((lengths, idx.astype("int32"), value, label.astype("float64"), weight.astype("float64"), held), protocol=5)
            yield pa.record_batch([pa.array([block], pa.int64()), pa.array([at[to == block][0]], pa.int64()), pa.array([data], pa.binary())], ["block", "at", "data"])


def _joined(items: Iterator[tuple[int, tuple[int, bytes]]]) -> Iterator[tuple[int, bytes]]:
    """Blocks of their parts: columns in use, then row, column and value of every entry, and label, weight and held run of every row."""
    parts: dict[int, list] = {}
    for block, part in items:
        parts.setdefault(block, []).append(part)
    while parts:
        block, own = parts.popitem()
        lengths, idx, value, label, weight, held = (np.concatenate(x) for x in zip(*(pickle.loads(data) for _, data in sorted(own))))
        columns, place = np.unique(idx, return_inverse=True)
        row = np.repeat(np.arange(len(lengths), dtype="int32"), lengths)
        yield block, pickle.dumps((columns, row, place.astype("int32"), value, label, weight, held), protocol=5)


def _shares(plan: _Plan, r: int, columns: np.ndarray) -> Iterator[tuple[int, slice, int]]:
    """(piece, its stretch of a block's sorted columns, its first column) for all pieces of a run."""
    for piece in range(plan.piece_at[r], plan.piece_at[r + 1]):
        start = (piece - plan.piece_at[r]) * plan.piece
        yield piece, slice(*np.searchsorted(columns, [start, start + plan.piece])), start


def _evaluate(plan: _Plan, block: int, data, told: dict[int, tuple]) -> Iterator[tuple]:
    """(piece, (block, gradient, residuals, loss)): the block at the coefficients that the pieces told it."""
    columns, row, place, value, label, weight, held = data
    # Indices of numpy's own width, and one buffer: neither is made anew for every run.
    row, place, product = row.astype(np.intp), place.astype(np.intp), np.empty(len(value))
    sign = 2 * label - 1
    for r in plan.runs_of_block(block):
        known = [told[p] for p in range(plan.piece_at[r], plan.piece_at[r + 1]) if p in told]
        if not known:
            continue
        own_weight = plan.C[r] * plan.weights(r, label, weight, held)
        beta = np.concatenate([b for b, _ in known])
        np.multiply(value, np.take(beta, place, out=product, mode="clip"), out=product)
        margin = np.bincount(row, product, len(label)) + sum(o for _, o in known)
        loss = float(own_weight @ np.logaddexp(0.0, -sign * margin))
        # The residual p - y without overflow.
        residual = -own_weight * sign * np.exp(-np.logaddexp(0.0, sign * margin))
        np.multiply(value, np.take(residual, row, out=product, mode="clip"), out=product)
        gradient = np.bincount(place, product, len(columns))
        for piece, own, _ in _shares(plan, r, columns):
            yield piece, (block, gradient[own], float(residual.sum()), loss)


@dataclass
class _Piece:
    """A stretch of a run's columns.  A point ``x`` is scaled: a coefficient is ``scale * x``."""

    routes: dict[int, np.ndarray]  #: the columns of each block, within the piece
    scale: np.ndarray
    shift: np.ndarray  #: what a coefficient adds to every margin: minus its column's mean, or 1 for the intercept
    ridge: np.ndarray  #: what the penalty multiplies a squared coefficient by
    free: int | None  #: place of the intercept
    first: np.ndarray  #: the first trial point


@dataclass
class _Point:
    """What a step leaves of a piece."""

    step: int
    x: np.ndarray
    g: np.ndarray | None  #: none where the run has ended here
    report: tuple | None = None


@dataclass
class _Move:
    """What a run does next: try ``weights . (steps, turns, gradient)`` from its point."""

    at: int | None = None  #: the step that gave the point; none before the first
    pairs: list[tuple[int, int]] = field(default_factory=list)  #: of points whose differences are the steps and turns
    weights: np.ndarray | None = None
    t: float = 1.0

    def needs(self) -> set[int]:
        return {k for pair in self.pairs for k in pair} | ({self.at} if self.at is not None else set())


def _start(plan: _Plan, piece: int, sums: list[tuple]) -> _Piece:
    r, start = plan.run_of_piece(piece), plan.start(piece)
    width = min(plan.piece, plan.widths[r] - start)
    count, first, second = np.zeros(width), np.zeros(width), np.zeros(width)
    for _, columns, n, a, b in sums:
        count[columns] += n
        first[columns] += a
        second[columns] += b
    mean = np.where(count >= plan.dense * plan.rows[r], first / plan.weight[r], 0.0)
    p = plan.prior(r)
    curvature = plan.C[r] * max(p * (1 - p), LEAST_CURVATURE)
    ridge = np.ones(width)
    if plan.standardized:
        # A column of one value has no deviation, and no coefficient.
        about = second - first * (first / plan.weight[r])
        ridge = np.where(about > 1e-12 * second, about, 0.0) / max(plan.weight[r] - plan.squares[r] / plan.weight[r], 1e-300)
    bent = ridge + curvature * np.maximum(second - mean * first, 0.0)
    scale = np.where(ridge > 0, 1 / np.sqrt(np.where(ridge > 0, bent, 1.0)), 0.0)
    shift, trial, free = -mean, np.zeros(width), None
    if start + width == plan.widths[r]:
        free = width - 1
        ridge[free] = 0.0
        scale[free], shift[free] = 1 / np.sqrt(curvature * plan.weight[r]), 1.0
        trial[free] = 0.0 if plan.one_class(r) else np.log(p / (1 - p)) / scale[free]
    return _Piece({b: c.astype("int32") for b, c, *_ in sums}, scale, shift, ridge, free, trial)


def _basis(piece: _Piece, move: _Move, points: dict[int, _Point]) -> tuple:
    """(point, its gradient, steps, turns) of a run's piece."""
    if move.at is None:
        zeros = np.zeros(len(piece.first))
        return zeros, zeros, [], []
    at = points[move.at]
    return at.x, at.g, [points[b].x - points[a].x for a, b in move.pairs], [points[b].g - points[a].g for a, b in move.pairs]


def _trial(piece: _Piece, move: _Move, basis: tuple) -> np.ndarray:
    x, g, steps, turns = basis
    return piece.first if move.at is None else x + move.t * (move.weights @ np.array([*steps, *turns, g]))


def _gathered(plan: _Plan, number: int, step: int, piece: _Piece, move: _Move, points: dict[int, _Point], parts: list[tuple]) -> _Point:
    """The trial point with its gradient, and the scalar products of the basis that accepting it would give."""
    x, old, steps, turns = basis = _basis(piece, move, points)
    trial = _trial(piece, move, basis)
    g, residual, loss = np.zeros(len(trial)), 0.0, 0.0
    # In the order of the blocks, so that a retry gives the same sum.
    for block, part, r, f in sorted(parts, key=lambda p: p[0]):
        g[piece.routes[block]] += part
        residual += r
        loss += f
    beta = piece.scale * trial
    pull = piece.ridge * beta
    g = piece.scale * (g + piece.shift * residual + pull)
    basis = np.array([*steps, trial - x, *turns, g - old, g])
    # Every piece knows the whole loss; the first one tells it.
    own = loss if number == plan.piece_at[plan.run_of_piece(number)] else 0.0
    return _Point(step, trial, g, (own + float(beta @ pull) / 2, basis @ basis.T))


@dataclass
class _Run:
    """The driver's view of a run."""

    value: float = np.inf
    products: np.ndarray | None = None  #: of (steps, turns, gradient)
    slope: float = 0.0
    move: _Move = field(default_factory=_Move)
    steps: int = 0
    done: bool = False

    def pairs(self) -> int:
        return 0 if self.products is None else len(self.products) // 2

    def decide(self, step: int, value: float, products: np.ndarray) -> None:
        """Take or shorten the step that was tried."""
        self.steps += 1
        first = self.products is None
        if not first and not value <= self.value + 1e-4 * self.move.t * self.slope + 1e-13 * abs(self.value):
            if self.move.t < 1e-12:
                self.done = True
                return
            self.move = replace(self.move, t=self.move.t / 2)
            return
        n = self.pairs() + 1
        bent = products[n - 1, 2 * n - 1]
        keep = not first and bent > 1e-12 * products[2 * n - 1, 2 * n - 1]
        gone = [] if keep else [n - 1, 2 * n - 1]
        if keep and n > MEMORY:
            gone = [0, n]
        self.products = np.delete(np.delete(products, gone, 0), gone, 1)
        self.value = value
        pairs = [*self.move.pairs, (self.move.at, step)][-MEMORY:] if keep else self.move.pairs
        if self.products[-1, -1] <= TOLERANCE**2:
            self.done, self.move = True, _Move(step)
            return
        weights = _direction(self.products)
        self.slope = float(weights @ self.products[-1])
        self.move = _Move(step, pairs, weights)


def _direction(products: np.ndarray) -> np.ndarray:
    """The two loops of limited-memory BFGS on weights of (steps, turns, gradient)."""
    n = len(products) // 2
    weights, back = np.zeros(2 * n + 1), np.zeros(n)
    weights[-1] = -1.0
    for i in reversed(range(n)):
        back[i] = weights @ products[i] / products[i, n + i]
        weights[n + i] -= back[i]
    if n:
        weights *= products[n - 1, 2 * n - 1] / products[2 * n - 1, 2 * n - 1]
    for i in range(n):
        weights[i] += back[i] - weights @ products[n + i] / products[i, n + i]
    return weights


def _drop_shuffles(rdd: RDD) -> None:
    """Delete the shuffle files that a computed RDD was made of, back to what is persisted.  Lost parts are made anew."""
    rdd._jrdd.rdd().cleanShuffleDependencies(True)


def _drop(rdd: RDD) -> None:
    """Free a persisted, checkpointed RDD that nothing reads any more."""
    path = rdd.getCheckpointFile()
    rdd.unpersist()
    if path:
        delete_folder(rdd.ctx, path)


def _sizes(rows: DataFrame, of: str) -> dict[tuple[int, float], np.ndarray]:
    """Entries, weight, rows and squared weights of every (run, class); the driver gets two rows a run."""
    found = rows.where(F.col("weight") > 0).groupBy(F.col(of).alias("run_id"), "label").agg(
        F.sum(F.size("entries") + 4), F.sum("weight").cast("double"), F.count(F.lit(1)), F.sum(F.col("weight") * F.col("weight")).cast("double")
    )
    return {(r["run_id"], r["label"]): np.array(r[2:], "float64") for r in found.collect()}


def fit_joint(
    rows: DataFrame,
    widths: Mapping[int, int],
    C: float = 1.0,
    piece: int = 1 << 15,
    dense: float = 0.0,
    held: str | None = None,
    regParam: float | None = None,
    classes: Mapping[int, float] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(run_id, idx, coef) and (run_id, intercept): for every run, the minimum of C * sum of weighted losses + |coef|^2 / 2.

    ``rows`` is a stored table (run_id, label, weight, entries), entries being (idx, w) pairs; ``widths`` are the columns
    of each run, kept in pieces of ``piece``; those with a value in a share ``dense`` of its rows are centred.  The intercept is not penalised.  A run of one class has no coefficients and an infinite intercept.
    With ``held``, a column in the place of run_id, a run takes all rows but those that are held for it: they are kept once for all runs,
    and ``classes`` may multiply the weights of the positive rows, run by run.
    With ``regParam``, the objective is MLlib's standardised one: mean loss + regParam / 2 * |coef times the column's deviation|^2.
    Raises when a run has not converged in ``MOST_STEPS`` evaluations.
    """
    spark = rows.sparkSession
    checkpoint_root(spark)
    cores = spark.sparkContext.defaultParallelism
    of = held or "run_id"
    own, none = _sizes(rows, of), np.zeros(4)
    if any(label not in (0.0, 1.0) for _, label in own):
        raise ValueError("labels must be 0 or 1")
    classes = {r: float((classes or {}).get(r, 1.0)) for r in widths}
    sizes = {}
    for r in widths:
        neg, pos = (own.get((r, label), none) for label in (0.0, 1.0))
        if held:
            neg, pos = (sum((s for (_, y), s in own.items() if y == label), none) - x for label, x in ((0.0, neg), (1.0, pos)))
        pos = pos * [1.0, classes[r], 1.0, classes[r] ** 2]
        if neg[2] + pos[2] > 0:
            sizes[r] = [*(neg + pos), pos[1]]
    if held:
        total = int(sum(own.values(), none)[0])
        blocks = [max(min(cores, -(-total * len(sizes) // BLOCK_ENTRIES)), -(-total // SHARED_ENTRIES))]
    else:
        blocks = [-(-int(sizes[r][0]) // BLOCK_ENTRIES) for r in sorted(widths) if r in sizes]
        total = sum(int(sizes[r][0]) for r in widths if r in sizes)
    runs = sorted(r for r in widths if r in sizes)
    weight = [float(sizes[r][1]) for r in runs]
    plan = _Plan(
        runs, [widths[r] + 1 for r in runs], blocks, held is not None, [classes[r] for r in runs],
        [C if regParam is None else 1 / (regParam * w) for w in weight], weight, [float(sizes[r][3]) for r in runs],
        [float(sizes[r][4]) for r in runs], [int(sizes[r][2]) for r in runs], piece, dense, regParam is not None,
    )
    if not runs:
        return spark.createDataFrame([], "run_id int, idx int, coef double"), spark.createDataFrame([], "run_id int, intercept double")
    n_blocks, n_pieces = plan.block_at[-1], plan.piece_at[-1]
    block_tasks = n_blocks if held else max(min(n_blocks, cores), -(-total // (2 * BLOCK_ENTRIES)))
    piece_tasks = max(min(n_pieces, cores), -(-sum(plan.widths) // (4 * piece)))

    rows = rows.withColumn("at", F.monotonically_increasing_id())
    if held:
        used, place = rows.where(F.col("weight") > 0), F.array(F.lit(0), F.lit(n_blocks))
    else:
        places = F.create_map(*[F.lit(x) for r, at, n in zip(runs, plan.block_at, plan.blocks) for x in (r, F.array(F.lit(at), F.lit(n)))])
        used, place = rows.where((F.col("weight") > 0) & F.col("run_id").isin(runs)), F.element_at(places, F.col("run_id"))
    dealt = used.select(
        (place[0] + F.pmod(F.col("at"), place[1])).cast("long").alias("block"), "at",
        "label", "weight", "entries", F.col(of).cast("long").alias("held"),
    )
    # The parts of the blocks are cut where the rows are read, so entries are shuffled once.
    cut = dealt.mapInArrow(_cut, "block long, at long, data binary").rdd.map(lambda r: (r["block"], (r["at"], bytes(r["data"]))))
    blocks = cut.partitionBy(block_tasks, int).mapPartitions(_joined, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)

    def first_sums(item):
        block, data = item
        columns, row, at, value, label, weight, held = pickle.loads(data)
        for r in plan.runs_of_block(block):
            w = plan.weights(r, label, weight, held)
            sums = [np.bincount(at, w[row] > 0, len(columns)), *(np.bincount(at, w[row] * value**k, len(columns)) for k in (1, 2))]
            for number, own, start in _shares(plan, r, columns):
                yield number, (block, columns[own] - start, *(x[own] for x in sums))

    def collected(items):
        by: dict[int, list] = {}
        for number, part in items:
            by.setdefault(number, []).append(part)
        return ((p, _start(plan, p, sorted(parts, key=lambda x: x[0]))) for p, parts in by.items())

    pieces = blocks.flatMap(first_sums).partitionBy(piece_tasks, int).mapPartitions(collected, preservesPartitioning=True)
    pieces = pieces.persist(StorageLevel.MEMORY_AND_DISK)
    pieces.count()
    _drop_shuffles(pieces)
    _drop_shuffles(blocks)
    states = [_Run(done=plan.one_class(r)) for r in range(len(runs))]
    points: dict[int, RDD] = {}
    step = 0
    while not all(s.done for s in states):
        moves = {r: s.move for r, s in enumerate(states)}
        open_ = frozenset(r for r, s in enumerate(states) if not s.done)
        after, back = _step(plan, step, blocks, pieces, list(points.values()), moves, open_, block_tasks, piece_tasks)
        after = after.persist(StorageLevel.MEMORY_AND_DISK)
        after.checkpoint()
        found: dict[int, list] = {}
        for r, report in after.flatMap(lambda p: [(plan.run_of_piece(p[0]), p[1].report)] if p[1].report else []).collect():
            found.setdefault(r, []).append(report)
        _drop_shuffles(back)
        for r, s in enumerate(states):
            if not s.done:
                s.decide(step, sum(f for f, _ in found[r]), sum(m for _, m in found[r]))
                if not s.done and s.steps >= MOST_STEPS:
                    raise RuntimeError(f"the fit did not converge in {MOST_STEPS} steps")
        points[step] = after
        # The last step has the points of the runs that ended before it, too.
        needed = {step}.union(*(s.move.needs() for r, s in enumerate(states) if r in open_))
        for k in points.keys() - needed:
            _drop(points.pop(k))
        step += 1

    last = {r: s.move.at for r, s in enumerate(states)}

    def result(items):
        held, at = {}, {}
        for number, what in items:
            if isinstance(what, _Piece):
                held[number] = what
            elif what.g is None or what.step == last[plan.run_of_piece(number)]:
                at[number] = what.x
        for number, piece in held.items():
            r = plan.run_of_piece(number)
            beta = np.zeros(len(piece.scale)) if plan.one_class(r) else piece.scale * at[number]
            named = beta if piece.free is None else beta[: piece.free]
            yield runs[r], plan.start(number), named.astype("float64").tobytes(), float(piece.shift @ beta)

    every = spark.sparkContext.union([pieces, *points.values()])
    parts = spark.createDataFrame(every.mapPartitions(result), "run_id int, start int, data binary, shift double")
    parts = store(parts, "pieces")
    for rdd in (blocks, pieces, *points.values()):
        _drop(rdd)

    def unpacked(batches):
        for batch in batches:
            for run, start, data in zip(*(batch.column(c).to_pylist() for c in ("run_id", "start", "data"))):
                coef = np.frombuffer(data)
                idx = np.arange(start, start + len(coef), dtype="int32")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(coef), run, "int32")), pa.array(idx), pa.array(coef)], ["run_id", "idx", "coef"])

    coefs = store(parts.select("run_id", "start", "data").mapInArrow(unpacked, "run_id int, idx int, coef double"), "coefficients")
    whole = {runs[r]: float("inf") if plan.positive[r] > 0 else float("-inf") for r in range(len(runs)) if plan.one_class(r)}
    intercepts = parts.groupBy("run_id").agg(F.sum("shift").alias("intercept"))
    if whole:
        fixed = F.element_at(F.create_map(*[F.lit(x) for kv in whole.items() for x in kv]), F.col("run_id"))
        intercepts = intercepts.withColumn("intercept", F.coalesce(fixed, "intercept"))
    return coefs, intercepts


def _step(plan, step, blocks, pieces, points, moves, open_, block_tasks, piece_tasks):
    """One evaluation of all open runs: the points of this step, and the messages that came back for them."""

    def known(items):
        """The pieces, the points that each has, and the messages for it."""
        held, at, parts = {}, {}, {}
        for number, what in items:
            if isinstance(what, _Piece):
                held[number] = what
            elif isinstance(what, _Point):
                at.setdefault(number, {})[None if what.g is None else what.step] = what
            else:
                parts.setdefault(number, []).append(what)
        return held, at, parts

    def tell(items):
        held, at, _ = known(items)
        for number, piece in held.items():
            r = plan.run_of_piece(number)
            if r in open_:
                beta = piece.scale * _trial(piece, moves[r], _basis(piece, moves[r], at.get(number, {})))
                shift = float(piece.shift @ beta)
                for block, columns in piece.routes.items():
                    yield block, (number, beta[columns], shift)

    def evaluate(items):
        held, told = {}, {}
        for block, what in items:
            if isinstance(what, bytes):
                held[block] = what
            else:
                told.setdefault(block, {})[what[0]] = what[1:]
        for block, parts in told.items():
            yield from _evaluate(plan, block, pickle.loads(held[block]), parts)

    def gather(items):
        held, at, parts = known(items)
        for number, piece in held.items():
            r, own = plan.run_of_piece(number), at.get(number, {})
            if r in open_:
                yield number, _gathered(plan, number, step, piece, moves[r], own, parts.get(number, []))
            elif not plan.one_class(r):
                yield number, own.get(None) or _Point(step, own[moves[r].at].x, None)

    union = blocks.ctx.union
    known_so_far = union([pieces, *points])
    told = known_so_far.mapPartitions(tell).partitionBy(block_tasks, int)
    back = union([blocks, told]).mapPartitions(evaluate).partitionBy(piece_tasks, int)
    return union([pieces, *points, back]).mapPartitions(gather, preservesPartitioning=True), back
