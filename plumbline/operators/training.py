"""Many small models trained at once: tasks sum the gradients of all of them over their rows, one sum a step goes to the driver.

A step is one pass over the rows whatever the number of models is: models of
all folds and configurations stand side by side in one matrix of parameters,
which goes to the tasks; what comes back has its size, not the table's. Rows
are read from where they lie; nothing is shuffled but a sum for each
parameter and task. Sums are in double precision; their order may change the
last digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Gradient = Callable[[pa.RecordBatch, np.ndarray], np.ndarray]

#: Adam's usual constants.
BETA_1, BETA_2, TINY = 0.9, 0.999, 1e-8


def summed(rows: DataFrame, gradient: Gradient, parameters: np.ndarray) -> np.ndarray:
    """The sum over all rows of what gradient gives for a batch: an array of the same shape for every batch."""
    shape = gradient(None, parameters).shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += gradient(batch, parameters)
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["i", "g"])

    sums = rows.mapInArrow(task, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).toArrow()
    out = np.zeros(int(np.prod(shape)))
    out[sums.column("i").to_numpy()] = sums.column("g").to_numpy()
    return out.reshape(shape)


def adam(rows: Sequence[DataFrame], gradient: Gradient, start: np.ndarray, rates: np.ndarray, steps: int, penalty: np.ndarray | float = 0.0, patience: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Parameters (models x parameters) after `steps` steps over the batches of rows in turn, and the losses before each step (steps x models).

    gradient gives for each model its gradient and, behind it, its loss; both
    are sums over rows. penalty: the weight of half the square of a parameter.
    patience: a model whose loss was no better for so many steps stands still,
    and in the end has the parameters with which its loss was best.
    """
    now, first, second = start.copy(), np.zeros(start.shape), np.zeros(start.shape)
    best, best_loss, waited = start.copy(), np.full(len(start), np.inf), np.zeros(len(start), dtype=int)
    losses = []
    for t in range(1, steps + 1):
        total = summed(rows[(t - 1) % len(rows)], gradient, now)
        loss = total[:, -1] + 0.5 * (penalty * now * now).sum(axis=1)
        losses.append(loss)
        better = loss < best_loss
        best[better], best_loss[better] = now[better], loss[better]
        waited = np.where(better, 0, waited + 1)
        g = total[:, :-1] + penalty * now
        first, second = BETA_1 * first + (1 - BETA_1) * g, BETA_2 * second + (1 - BETA_2) * g * g
        moved = rates[:, None] * (first / (1 - BETA_1**t)) / (np.sqrt(second / (1 - BETA_2**t)) + TINY)
        still = np.zeros(len(now), dtype=bool) if patience is None else waited >= patience
        if still.all():
            break
        now = np.where(still[:, None], now, now - moved)
    return (now if patience is None else best), np.array(losses)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def losses_of(logits: np.ndarray, y: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The loss of each prediction and its derivative by the logit: bce, focal (exponent 2) or brier (twice the square)."""
    p = sigmoid(logits)
    if kind == "bce":
        return np.logaddexp(0, logits) - y * logits, p - y
    if kind == "brier":
        return 2 * (p - y) ** 2, 4 * (p - y) * p * (1 - p)
    sign = 2 * y - 1
    right, log_right = np.where(y == 1, p, 1 - p), -np.logaddexp(0, -sign * logits)
    wrong = 1 - right
    return -wrong * wrong * log_right, sign * (2 * right * wrong * wrong * log_right - wrong**3)


# --- a grid of linear models in one pass ---


def _matrix(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return np.concatenate([values, np.ones((len(values), 1))], axis=1)


def linear_grid(spark: SparkSession, rows: DataFrame, folds: int, configurations: list[dict], width: int, steps: int = 30, vector: str = "embedding", y: str = "y", fold: str = "fold") -> tuple[DataFrame, np.ndarray]:
    """Logistic models for every configuration (rate, penalty, loss) and fold, each fitted without its fold and measured on it.

    Gives a table with a row for each configuration and fold (configuration,
    rate, penalty, loss, fold, n, brier, log_loss) and all parameters
    (configuration-major, the intercept last). One pass a step trains all of
    them; one more measures them.
    """
    models = [(c, k) for c in configurations for k in range(folds)]
    own = np.array([k for _, k in models])
    kinds = np.array([c.get("loss", "bce") for c, _ in models])
    data = rows.select(F.col(vector).cast("array<double>").alias("v"), F.col(y).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"))
    sizes = {r[0]: r[1] for r in data.groupBy("fold").count().collect()}
    train = np.array([max(1, sum(sizes.values()) - sizes.get(k, 0)) for k in own], dtype=float)

    def predicted(batch: pa.RecordBatch, parameters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x, labels, of = _matrix(batch, "v", width), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
        return x, labels[:, None], of[:, None] != own[None, :], x @ parameters.T

    def gradient(batch: pa.RecordBatch | None, parameters: np.ndarray) -> np.ndarray:
        out = np.zeros((len(models), width + 2))
        if batch is None:
            return out
        x, labels, mine, logits = predicted(batch, parameters)
        for kind in set(kinds):
            these = kinds == kind
            loss, slope = losses_of(logits[:, these], labels, kind)
            weight = mine[:, these] / train[these]
            out[these, :-1] = (slope * weight).T @ x
            out[these, -1] = (loss * weight).sum(axis=0)
        return out

    def measured(batch: pa.RecordBatch | None, parameters: np.ndarray) -> np.ndarray:
        if batch is None:
            return np.zeros((len(models), 3))
        _, labels, mine, logits = predicted(batch, parameters)
        held = ~mine
        return np.stack([held.sum(axis=0), ((sigmoid(logits) - labels) ** 2 * held).sum(axis=0), (losses_of(logits, labels, "bce")[0] * held).sum(axis=0)], axis=1)

    penalty = np.array([[c.get("penalty", 0.0)] * width + [0.0] for c, _ in models])
    rates = np.array([c.get("rate", 0.1) for c, _ in models])
    found, _ = adam([data], gradient, np.zeros((len(models), width + 1)), rates, steps, penalty)
    sums = summed(data, measured, found)
    made = [
        (i // folds, float(c.get("rate", 0.1)), float(c.get("penalty", 0.0)), c.get("loss", "bce"), k, int(n), float(b / n) if n else None, float(e / n) if n else None)
        for i, ((c, k), (n, b, e)) in enumerate(zip(models, sums, strict=True))
    ]
    return spark.createDataFrame(made, "configuration int, rate double, penalty double, loss string, fold int, n long, brier double, log_loss double"), found


def best_by_fold(grid: DataFrame) -> DataFrame:
    """For each fold the configuration with the least mean Brier score on the other folds, and its score on this one."""
    mine = grid.select("configuration", F.col("fold").alias("held"), "n", F.col("brier").alias("own"))
    others = grid.join(mine.select("configuration", "held"), "configuration").where("fold <> held").groupBy("held", "configuration").agg(F.avg("brier").alias("others"))
    best = others.groupBy("held").agg(F.min(F.struct("others", "configuration")).alias("b")).select("held", F.col("b.configuration").alias("configuration"), F.col("b.others").alias("others"))
    settings = grid.select("configuration", "rate", "penalty", "loss").distinct()
    return best.join(mine, ["configuration", "held"]).join(settings, "configuration").select(F.col("held").alias("fold"), "configuration", "rate", "penalty", "loss", "n", F.col("own").alias("brier"), "others")


def spread_by_configuration(grid: DataFrame) -> DataFrame:
    """configuration, rate, penalty, loss, folds, and the mean and population std of brier and log_loss over the folds that have rows."""
    held = grid.where("n > 0")
    return held.groupBy("configuration", "rate", "penalty", "loss").agg(
        F.count("*").alias("folds"), *[f(c).alias(f"{c}_{k}") for c in ("brier", "log_loss") for k, f in (("mean", F.avg), ("std", F.stddev_pop))]
    )


# --- a probe of tokens, lines and problems with shared weights ---

LEVELS = ("token", "line", "problem")


def problem_rows(tokens: DataFrame, problem: str, line: str, pos: str, vector: str = "embedding", y: str = "y", folds: int = 5, batches: int = 1) -> DataFrame:
    """A row for each problem: its lines' numbers, labels and vectors by token, in order; its fold and its batch by hashes of the problem."""
    item = F.struct(line, pos, F.col(y).cast("int").alias("_y"), F.col(vector).cast("array<double>").alias("_v"))
    seed = F.xxhash64(F.col(problem).cast("string"))
    rows = tokens.groupBy(problem).agg(F.array_sort(F.collect_list(item)).alias("_t"))
    return rows.select(
        F.col(problem).alias("problem"),
        F.pmod(seed, F.lit(folds)).cast("int").alias("fold"),
        F.pmod(F.shiftright(seed, 20), F.lit(batches)).cast("int").alias("batch"),
        F.transform("_t", lambda t: t[line].cast("long")).alias("lines"),
        F.transform("_t", lambda t: t[pos].cast("long")).alias("places"),
        F.transform("_t", lambda t: t["_y"]).alias("ys"),
        F.flatten(F.transform("_t", lambda t: t["_v"])).alias("vectors"),
    )


class LineProbe:
    """A hidden layer with GELU over token vectors, pooled by line and by problem; the same output weights tell all three levels.

    Each problem is a row, so a line's or problem's tokens are together. The
    label of a line or problem is the least of its tokens'. folds models are
    trained at once, each without its fold.
    """

    def __init__(self, width: int, hidden: int = 16, pool: str = "mean", loss: str = "bce", weights: Sequence[float] = (1.0, 0.5, 0.25), folds: int = 5, seed: int = 1):
        self.width, self.hidden, self.pool, self.loss, self.weights, self.folds = width, hidden, pool, loss, tuple(weights), folds
        self.size = width * hidden + 2 * hidden + 1
        one = np.random.default_rng(seed).normal(0, 1, self.size)
        one[: width * hidden] /= np.sqrt(width)
        one[width * hidden : -1] *= 0.1
        one[-1] = 0.0
        self.start = np.tile(one, (folds, 1))

    def _parts(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        d, h = self.width, self.hidden
        return p[: d * h].reshape(d, h), p[d * h : d * h + h], p[d * h + h : -1], p[-1]

    def _layout(self, batch: pa.RecordBatch) -> dict:
        lines, counts = batch.column("lines"), np.diff(batch.column("lines").offsets.to_numpy())
        ids, y = lines.flatten().to_numpy(zero_copy_only=False), batch.column("ys").flatten().to_numpy(zero_copy_only=False).astype(float)
        used = counts > 0
        firsts = (np.cumsum(counts) - counts)[used]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = ids[1:] != ids[:-1]
        new[firsts] = True
        starts = {"token": np.arange(len(ids)), "line": np.flatnonzero(new), "problem": firsts}
        fold = np.repeat(batch.column("fold").to_numpy(), counts)
        return {
            "x": batch.column("vectors").flatten().to_numpy(zero_copy_only=False).reshape(-1, self.width),
            "starts": starts,
            "y": {k: np.minimum.reduceat(y, s) if len(y) else y for k, s in starts.items()},
            "fold": {k: fold[s] for k, s in starts.items()},
        }

    def _pooled(self, a: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if self.pool == "max":
            return np.maximum.reduceat(a, starts)
        return np.add.reduceat(a, starts) / np.diff([*starts, len(a)])[:, None]

    def _back(self, a: np.ndarray, pooled: np.ndarray, starts: np.ndarray, slope: np.ndarray) -> np.ndarray:
        sizes = np.diff([*starts, len(a)])
        if self.pool == "mean":
            return np.repeat(slope / sizes[:, None], sizes, axis=0)
        top = a == np.repeat(pooled, sizes, axis=0)
        seen = np.cumsum(top, axis=0)
        first = top & (seen - np.repeat(seen[starts] - top[starts], sizes, axis=0) == 1)  # of equal ones the first
        return np.repeat(slope, sizes, axis=0) * first

    def forward(self, x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hidden layer's values and their derivatives by what goes in."""
        w, b, _, _ = self._parts(p)
        z = x @ w + b
        c = np.sqrt(2 / np.pi)
        t = np.tanh(c * (z + 0.044715 * z**3))
        return 0.5 * z * (1 + t), 0.5 * (1 + t) + 0.5 * z * (1 - t * t) * c * (1 + 3 * 0.044715 * z * z)

    def gradient(self, sizes: dict[tuple[str, int], int]) -> Gradient:
        """Sums over a batch for all folds' models; sizes: how many predictions of a level each model is trained on."""

        def run(batch: pa.RecordBatch | None, parameters: np.ndarray) -> np.ndarray:
            out = np.zeros((self.folds, self.size + 1))
            if batch is None:
                return out
            at = self._layout(batch)
            if not len(at["x"]):
                return out
            d, h = self.width, self.hidden
            for k in range(self.folds):
                a, da = self.forward(at["x"], parameters[k])
                _, _, v, c = self._parts(parameters[k])
                back, loss_sum, gv, gc = np.zeros(a.shape), 0.0, np.zeros(h), 0.0
                for level, weight in zip(LEVELS, self.weights, strict=True):
                    starts = at["starts"][level]
                    pooled = a if level == "token" else self._pooled(a, starts)
                    loss, slope = losses_of(pooled @ v + c, at["y"][level], self.loss)
                    share = weight * (at["fold"][level] != k) / max(1, sizes[level, k])
                    slope = slope * share
                    loss_sum += float((loss * share).sum())
                    gv, gc = gv + pooled.T @ slope, gc + slope.sum()
                    down = slope[:, None] * v[None, :]
                    back += down if level == "token" else self._back(a, pooled, starts, down)
                dz = back * da
                out[k, : d * h] = (at["x"].T @ dz).ravel()
                out[k, d * h : d * h + h] = dz.sum(axis=0)
                out[k, d * h + h : -2] = gv
                out[k, -2], out[k, -1] = gc, loss_sum
            return out

        return run

    def sizes(self, problems: DataFrame) -> dict[tuple[str, int], int]:
        one = problems.select("fold", F.size("ys").alias("token"), F.size(F.array_distinct("lines")).alias("line"), (F.size("ys") > 0).cast("int").alias("problem"))
        by = {r["fold"]: r for r in one.groupBy("fold").agg(*[F.sum(c).alias(c) for c in LEVELS]).collect()}
        return {(level, k): sum(r[level] for f, r in by.items() if f != k) for level in LEVELS for k in range(self.folds)}

    def fit(self, problems: DataFrame, steps: int = 40, rate: float = 0.01, batches: int = 1, patience: int | None = None, penalty: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Parameters of all folds' models and their losses by step; batches: of how many parts (by the column batch) each step takes one in turn."""
        parts = [problems if batches == 1 else problems.where(F.col("batch") == b) for b in range(batches)]
        whole = self.sizes(problems)
        share = {key: n / batches for key, n in whole.items()}
        return adam(parts, self.gradient(share), self.start, np.full(self.folds, rate), steps, penalty, patience)

    def predict(self, problems: DataFrame, parameters: np.ndarray) -> DataFrame:
        """(problem, fold, level, line, place, p, y) of every token, line and problem by the model that didn't see it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = self._layout(batch)
                if not len(at["x"]):
                    continue
                counts = np.diff(batch.column("lines").offsets.to_numpy())
                owner = np.repeat(np.arange(batch.num_rows), counts)
                lines, places = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("lines", "places"))
                for level in LEVELS:
                    starts, fold = at["starts"][level], at["fold"][level]
                    p = np.zeros(len(starts))
                    for k in range(self.folds):
                        if (fold == k).any():
                            a, _ = self.forward(at["x"], parameters[k])
                            _, _, v, c = self._parts(parameters[k])
                            scored = sigmoid((a if level == "token" else self._pooled(a, starts)) @ v + c)
                            p[fold == k] = scored[fold == k]
                    none = np.zeros(len(starts), dtype=bool)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("problem").take(pa.array(owner[starts])),
                            pa.array(fold, pa.int32()),
                            pa.array([level] * len(starts)),
                            pa.array(lines[starts], mask=none | (level == "problem")),
                            pa.array(places[starts], mask=none | (level != "token")),
                            pa.array(p),
                            pa.array(at["y"][level].astype(np.int64)),
                        ],
                        names=["problem", "fold", "level", "line", "place", "p", "y"],
                    )

        kind = problems.schema["problem"].dataType.simpleString()
        return problems.select("problem", "fold", "lines", "places", "ys", "vectors").mapInArrow(run, f"problem {kind}, fold int, level string, line long, place long, p double, y long")
