"""Secret scan: findings by rule, and further ones by a small character network learned from them.

Three rules give the base findings (``RULES``). They are also the labelled examples: the value of a base finding is a
secret, a run of RUN or more characters of the secret alphabet that touches none is ordinary text. Both are candidates,
and with CONTEXT characters on either side they are what the network reads: characters and whether they are inside the
candidate are embedded and convolved WIDTH at a time. The largest response of each filter anywhere and its mean over the
whole candidate, read in pieces if it is long, go into a logistic output. Half of the training examples stand in the context of an ordinary
run, so that the network learns what a secret looks like and not only what stands before it.

Training starts on the driver with a bounded first part of the candidates. Where there are more, rounds over all of them follow: tasks
add up the slopes of their candidates, and only the sums meet. So the weights are those of all candidates outside the fold.

Outputs are calibrated on a fold that training does not see (Platt's method, with the corpus's own share of secrets), all of it, by tasks.
The threshold of a shape of values (hexadecimal, or other) must keep RECALL of that fold's secrets of the shape when
they stand in ordinary contexts, as whatever the rules miss does; it is halfway from the lowest secret kept down to the
highest ordinary run below. All runs of the fold count, by how likely each is ordinary: some are secrets that the rules missed, a large
fold always has some, and what the network gives for them is mixed from what it gives for secrets and for ordinary text, in shares
that the fold tells. Candidates beyond the threshold are added to the base findings, which all stay.

Texts are read once; findings and candidates, a small part of them, are written, and the network reads those.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthspark.llm.common import without, written
from hearthspark.operators import quantiles

#: The rules and the lengths that their values must have. ``assign`` takes letters of its names in either case.
RULES = {
    "assign": (re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]{32,}"), 0, 32),
}
KINDS = [*RULES, "model"]
#: Runs that the network reads beside the findings.
RUN = 16
_RUNS = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % RUN)
CONTEXT = 24

#: Distinct labelled candidates of each label that training starts with, and characters of a value that training reads.
FIT_ROWS, FIT_CHARS = 1024, 160
#: Rounds over all candidates where there are more, candidates whose slopes are taken at once, and those that one task numbers.
ROUNDS, SLICE, NUMBERED = 16, 256, 65_536
#: Fewer of either label teach nothing: no model, no added findings.
FEWEST = 8
#: Share of the calibration fold's secrets that thresholds keep, the fold: one candidate in so many, and bins in which its ordinary
#: runs are counted.
RECALL, FOLDS, BINS = 0.98, 4, 4096

#: The network: size of a character's vector, characters of a filter, filters, characters read at once.
VECTOR, WIDTH, FILTERS, PIECE = 8, 5, 24, 128
EPOCHS, BATCH, RATE = 10, 64, 0.01

_ROW = T.StructType(
    [
        T.StructField("base", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField(
            "candidates",
            T.ArrayType(
                T.StructType(
                    [T.StructField("start", T.LongType()), T.StructField("secret", T.BooleanType())]
                    + [T.StructField(c, T.StringType()) for c in ("before", "value", "after")]
                )
            ),
        ),
    ]
)


def findings(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, end, kind, start of value, end of value) by rule, by start, then kind; kinds are places in KINDS."""
    out = []
    for kind, (pattern, group, least) in enumerate(RULES.values()):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), m.end(), kind, m.start(group), m.end(group)))
    return sorted(out, key=lambda x: (x[0], x[2]))


def candidates(text: str, base: list[tuple[int, int, int, int, int]]) -> list[dict]:
    """Values of findings, and runs that touch no finding, with their context."""
    spans = [(a, b, True) for a, b in sorted({(x[3], x[4]) for x in base})]
    taken = sorted((x[0], x[1]) for x in base)
    at = reach = 0
    for m in _RUNS.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= m.start():
            spans.append((m.start(), m.end(), False))
    return [
        {"start": a, "secret": s, "before": text[max(0, a - CONTEXT) : a], "value": text[a:b], "after": text[b : b + CONTEXT]}
        for a, b, s in spans
    ]


@F.arrow_udf(_ROW)
def _read(text: pa.Array) -> pa.Array:
    out = []
    for value in text:
        whole = value.as_py() or ""
        base = findings(whole)
        out.append({"base": [list(x[:3]) for x in base], "candidates": candidates(whole, base)})
    return pa.array(out, type=_ARROW)


_ARROW = pa.struct(
    [
        ("base", pa.list_(pa.list_(pa.int64()))),
        (
            "candidates",
            pa.list_(
                pa.struct([("start", pa.int64()), ("secret", pa.bool_()), ("before", pa.string()), ("value", pa.string()), ("after", pa.string())])
            ),
        ),
    ]
)


Example = tuple[str, str, str]


def _moved(rows: list[Example], secret: np.ndarray, rng: np.random.Generator, which: np.ndarray) -> list[Example]:
    """Examples, those of ``which`` in the context of an ordinary one."""
    places = rng.choice(np.flatnonzero(~secret), len(rows))
    return [(rows[at][0], row[1], rows[at][2]) if on else row for row, at, on in zip(rows, places.tolist(), which, strict=True)]


def _begun(row: Example) -> Example:
    """What training reads of an example: its value's first FIT_CHARS characters."""
    return row[0], row[1][:FIT_CHARS], row[2]


def _codes(before: str, value: str, after: str) -> np.ndarray:
    """Characters as numbers from 1 to 128, those beyond ASCII as one; 128 more inside the value. 0 is nothing."""
    raw = np.frombuffer((before + value + after).encode("utf-32-le"), dtype="<u4")
    codes = np.minimum(raw, 127).astype(np.int64) + 1
    codes[len(before) : len(before) + len(value)] += 128
    return codes


def _inside(pieces: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Whether a place of a piece counts and touches the value."""
    touches = sliding_window_view(pieces > 128, WIDTH, axis=1).any(2)
    return touches & (np.arange(touches.shape[1])[None, :] < count[:, None])


def _pieces(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of PIECE numbers that overlap by WIDTH - 1, the first piece of each row, and places that count, by piece."""
    whole, first, count = [], [], []
    step = PIECE - WIDTH + 1
    for row in rows:
        first.append(len(whole))
        places = max(1, len(row) - WIDTH + 1)
        for lo in range(0, places, step):
            piece = row[lo : lo + PIECE]
            whole.append(np.pad(piece, (0, PIECE - len(piece))))
            count.append(min(step, places - lo))
    return np.array(whole, dtype=np.int64).reshape(-1, PIECE), np.array(first, dtype=np.int64), np.array(count, dtype=np.int64)


@dataclass
class Adam:
    """Steps of Adam's method, with what it remembers between them."""

    means: dict[str, np.ndarray] = field(default_factory=dict)
    squares: dict[str, np.ndarray] = field(default_factory=dict)
    steps: int = 0

    def step(self, weights: dict[str, np.ndarray], slopes: dict[str, np.ndarray]) -> None:
        self.steps += 1
        for name, slope in slopes.items():
            self.means[name] = 0.9 * self.means.get(name, 0) + 0.1 * slope
            self.squares[name] = 0.999 * self.squares.get(name, 0) + 0.001 * slope**2
            weights[name] -= RATE * (self.means[name] / (1 - 0.9**self.steps)) / (np.sqrt(self.squares[name] / (1 - 0.999**self.steps)) + 1e-8)


@dataclass
class Network:
    """Embedding, filters and output of the network; ``scale``, ``shift`` and ``thresholds`` come from calibration."""

    weights: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, float] = (0.5, 0.5)

    @classmethod
    def fresh(cls, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        return cls(
            {
                "vectors": rng.normal(0, 0.5, (257, VECTOR)),
                "filters": rng.normal(0, (2 / (WIDTH * VECTOR)) ** 0.5, (WIDTH * VECTOR, FILTERS)),
                "bias": np.zeros(FILTERS),
                "out": rng.normal(0, 0.1, 2 * FILTERS),
                "base": np.zeros(1),
            }
        )

    def responses(self, pieces: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What every filter sees at every place of every piece, and the windows that it saw; places beyond count are 0."""
        w = self.weights
        seen = sliding_window_view(w["vectors"][pieces], WIDTH, axis=1).swapaxes(2, 3).reshape(len(pieces), -1, WIDTH * VECTOR)
        out = np.maximum(seen @ w["filters"] + w["bias"], 0)
        out[np.arange(out.shape[1])[None, :] >= count[:, None]] = 0
        return out, seen

    def logits(self, rows: list[np.ndarray]) -> np.ndarray:
        """The output for every row, whole, a bounded number of pieces at a time."""
        pieces, first, count = _pieces(rows)
        most, total = np.zeros((len(pieces), FILTERS)), np.zeros((len(pieces), FILTERS))
        places = np.zeros(len(pieces))
        for lo in range(0, len(pieces), 512):
            some = slice(lo, lo + 512)
            out, _ = self.responses(pieces[some], count[some])
            inside = _inside(pieces[some], count[some])
            most[some], total[some], places[some] = out.max(1), (out * inside[:, :, None]).sum(1), inside.sum(1)
        if not rows:
            return np.empty(0)
        features = np.concatenate(
            [np.maximum.reduceat(most, first), np.add.reduceat(total, first) / np.add.reduceat(places, first)[:, None]], axis=1
        )
        return features @ self.weights["out"] + self.weights["base"]

    def probability(self, rows: list[np.ndarray]) -> np.ndarray:
        return _logistic(self.scale * self.logits(rows) + self.shift)

    def train(self, rows: list[Example], secret: np.ndarray, seed: int = 0) -> Adam:
        """Adam on the logistic loss, with both labels of equal weight; every second example is moved."""
        rng = np.random.default_rng(seed)
        share = np.where(secret, 0.5 / secret.mean(), 0.5 / (1 - secret.mean()))
        adam = Adam()
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            shown_as = _moved(rows, secret, rng, rng.random(len(rows)) < 0.5)
            for lo in range(0, len(rows), BATCH):
                some = order[lo : lo + BATCH]
                adam.step(self.weights, self._slopes([_codes(*_begun(shown_as[i])) for i in some], secret[some], share[some]))
        return adam

    def _slopes(self, rows: list[np.ndarray], secret: np.ndarray, share: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        pieces, first, count = _pieces(rows)
        out, seen = self.responses(pieces, count)
        owner = np.repeat(np.arange(len(rows)), np.diff(np.concatenate([first, [len(pieces)]])))
        inside = _inside(pieces, count)[:, :, None]
        places = np.add.reduceat(inside.sum((1, 2)), first)
        most = np.maximum.reduceat(out.max(1), first)
        features = np.concatenate([most, np.add.reduceat((out * inside).sum(1), first) / places[:, None]], axis=1)
        away = (_logistic(features @ w["out"] + w["base"]) - secret) * share / len(rows)
        back = away[:, None] * w["out"][None, :]
        # The mean goes back to the places inside, the largest in equal parts to the places that have it.
        top = out == most[owner][:, None, :]
        parts = back[:, :FILTERS] / np.maximum(np.add.reduceat(top.sum(1), first), 1)
        slope = (back[:, FILTERS:] / places[:, None])[owner][:, None, :] * inside + np.where(top, parts[owner][:, None, :], 0)
        slope[out <= 0] = 0
        flat = slope.reshape(-1, FILTERS)
        windows = (flat @ w["filters"].T).reshape(len(pieces), -1, WIDTH, VECTOR)
        by_place = np.zeros((*pieces.shape, VECTOR))
        for k in range(WIDTH):
            by_place[:, k : k + windows.shape[1]] += windows[:, :, k]
        flown = [np.bincount(pieces.ravel(), weights=by_place[..., v].ravel(), minlength=len(w["vectors"])) for v in range(VECTOR)]
        return {
            "vectors": np.stack(flown, axis=1),
            "filters": seen.reshape(-1, WIDTH * VECTOR).T @ flat,
            "bias": flat.sum(0),
            "out": features.T @ away,
            "base": away.sum(keepdims=True),
        }


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _hexadecimal(value: str) -> bool:
    return not set(value) - set("0123456789abcdef")


def _sliced(distinct: DataFrame, number: dict[bool, int]) -> DataFrame:
    """Labelled candidates with ``held``, by SLICE or so in a row: (held, slice, examples).

    Every FOLDS-th of a label is held, by its place in the order of hashes. Labels of many candidates are
    numbered by parts of them, so that no task orders all. Slices are dealt to tasks by number, as they are much work and few bytes.
    """
    parts = F.when(F.col("secret"), -(-number[True] // NUMBERED)).otherwise(-(-number[False] // NUMBERED))
    place = F.row_number().over(Window.partitionBy("secret", F.pmod("hash", parts)).orderBy("hash", "before", "value", "after"))
    slices = -(-sum(number.values()) // SLICE)
    example = F.struct("hash", "before", "value", "after", "secret")
    tasks = min(slices, max(4 * distinct.sparkSession.sparkContext.defaultParallelism, slices // SLICE))
    return (
        distinct.withColumns({"held": (place - 1) % FOLDS == 0, "slice": F.pmod("hash", F.lit(slices))})
        .groupBy("held", "slice")
        .agg(F.sort_array(F.collect_list(example)).alias("examples"))
        .repartition(tasks, "slice")
    )


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[Example], np.ndarray]]:
    """The slices of a task: number, examples and which of them are secrets."""
    for batch in batches:
        for number, rows in zip(batch.column("slice").to_pylist(), batch.column("examples"), strict=True):
            listed = rows.as_py()
            yield number, [(r["before"], r["value"], r["after"]) for r in listed], np.array([r["secret"] for r in listed])


def _placed(rows: list[Example], secret: np.ndarray, rng: np.random.Generator, which: np.ndarray, spare: list[Example]) -> list[Example]:
    """Examples moved as in ``_moved``, with ``spare`` ordinary ones to give contexts if there are none among the rows."""
    if not secret.all():
        return _moved(rows, secret, rng, which)
    own = len(rows)
    label = np.concatenate([secret, np.zeros(len(spare), dtype=bool)])
    return _moved(rows + spare, label, rng, np.concatenate([which, np.zeros(len(spare), dtype=bool)]))[:own]


def _slopes_of_all(slices: DataFrame, model: Network, share: dict[bool, float], spare: list[Example], round_: int) -> dict[str, np.ndarray]:
    """The slopes of the loss summed over the candidates of all slices; every second is moved, another half in each round."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for number, rows, secret in _examples(batches):
            rng = np.random.default_rng([round_, number])
            shown = _placed(rows, secret, rng, rng.random(len(rows)) < 0.5, spare)
            weight = np.where(secret, share[True], share[False])
            for name, slope in model._slopes([_codes(*_begun(x)) for x in shown], secret, weight).items():
                total[name] = total.get(name, 0) + slope * len(rows)
        if total:
            yield pa.RecordBatch.from_pydict({"name": list(total), "slope": [x.ravel() for x in total.values()]}, schema=sums)

    sums = pa.schema([("name", pa.string()), ("slope", pa.list_(pa.float64()))])
    out = {name: np.zeros(weight.size) for name, weight in model.weights.items()}
    for r in slices.mapInArrow(summed, "name string, slope array<double>").collect():
        out[r.name] += np.array(r.slope)
    return {name: slope.reshape(model.weights[name].shape) for name, slope in out.items()}


def _read_moved(slices: DataFrame, model: Network, spare: list[Example]) -> DataFrame:
    """(secret, hexadecimal, x) of all candidates of the slices: what the network gives for them in ordinary contexts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows, secret in _examples(batches):
            moved = _placed(rows, secret, np.random.default_rng([ROUNDS, number]), np.ones(len(rows), dtype=bool), spare)
            shape = [_hexadecimal(value) for _, value, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(secret), pa.array(shape), pa.array(model.logits([_codes(*x) for x in moved]))], names=["secret", "hexadecimal", "x"]
            )

    return slices.mapInArrow(read, "secret boolean, hexadecimal boolean, x double")


def _likely_ordinary(scored: DataFrame, n: int, m: int, a: float, b: float) -> float:
    """The highest of all ordinary runs that is more likely ordinary text than a secret that the rules missed.

    The runs are a mixture of two normal laws: that of ordinary text, and that of the ``n`` secrets of the fold, of which there
    is an unknown share among the ``m`` runs. Laws and share are found in turn, beginning with the chances of Platt's ``a`` and
    ``b``, from counts and sums of all runs in BINS bins. Fewer than FEWEST secrets tell no law: all runs are text then.
    """
    x = F.col("x")
    runs = scored.filter(~F.col("secret"))
    low, high = runs.agg(F.min("x"), F.max("x")).first()
    if low == high or n < FEWEST:
        return high
    bin_ = F.least(F.floor((x - low) / ((high - low) / BINS)), F.lit(BINS - 1))
    found = runs.groupBy(bin_.alias("bin")).agg(F.count("*"), F.sum("x"), F.sum(x * x), F.max("x")).collect()
    count, total, square, top = (np.array([r[i] for r in found], dtype=float) for i in range(1, 5))
    mean = total / count
    known = scored.filter("secret").agg(F.sum("x"), F.sum(x * x)).first()
    chance = _logistic(a * mean + b)
    for _ in range(500):
        hidden = float((count * chance).sum())
        laws = []
        for weight, more in ((chance, (n, known[0], known[1])), (1 - chance, (0, 0.0, 0.0))):
            size = max(float((count * weight).sum()) + more[0], 1e-9)
            middle = (float((total * weight).sum()) + more[1]) / size
            laws.append((middle, max((float((square * weight).sum()) + more[2]) / size - middle**2, 1e-6)))
        of_secret, of_text = (-((mean - at) ** 2) / (2 * wide) - np.log(wide) / 2 for at, wide in laws)
        share = np.clip(hidden / m, 1e-12, 1 - 1e-12)
        was, chance = chance, _logistic(of_secret - of_text + np.log(share / (1 - share)))
        # Either law may be the wider one: up to the middle of text all is text, and above it a higher run is no less likely a secret.
        chance[mean <= laws[1][0]] = 0
        order = np.argsort(mean)
        chance[order] = np.maximum.accumulate(chance[order])
        if np.abs(chance - was).max() < 1e-9:
            break
    return float(top[chance < 0.5].max(initial=low))


def calibrate(model: Network, scored: DataFrame, odds: float) -> None:
    """Platt's scale and shift from all of ``scored``, for a corpus with these odds of a secret, and the thresholds by shape.

    Sums and ranks are counted in Spark, a few numbers a step.
    """
    x, secret = F.col("x"), F.col("secret")
    sizes = {(r.secret, r.hexadecimal): r.n for r in scored.groupBy("secret", "hexadecimal").agg(F.count("*").alias("n")).collect()}
    n, m = (sum(k for (label, _), k in sizes.items() if label == of) for of in (True, False))
    target = F.when(secret, (n + 1) / (n + 2)).otherwise(1 / (m + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + F.exp(-F.greatest(F.least(x * a + b, F.lit(60.0)), F.lit(-60.0))))
        away, c = p - target, p * (1 - p)
        s = scored.agg(*[F.sum(v) for v in (away * x, away, c * x * x, c * x, c)]).first()
        move = np.clip(np.linalg.solve(np.array([[s[2] + 1e-3, s[3]], [s[3], s[4] + 1e-3]]), np.array([s[0], s[1]])), -2, 2)
        a, b = a - float(move[0]), b - float(move[1])
        if np.abs(move).max() < 1e-9:
            break
    model.scale, model.shift = max(a, 1e-3), b + float(np.log(odds * m / n))

    ordinary = _likely_ordinary(scored, n, m, a, b)

    def threshold(kept: DataFrame, number: int) -> float:
        """Halfway, in log odds, from the highest threshold that keeps RECALL of the secrets down to the highest ordinary one."""
        highest = quantiles.nth_smallest(kept, "x", int((1 - RECALL) * number) + 1)
        return float(_logistic(model.scale * (highest + min(highest, ordinary)) / 2 + model.shift))

    secrets = scored.filter(secret)
    every = threshold(secrets, n)
    model.thresholds = tuple(
        threshold(secrets.filter(F.col("hexadecimal") == shape), of) if (of := sizes.get((True, shape), 0)) >= FEWEST else every
        for shape in (False, True)
    )


def fit(read: DataFrame) -> Network | None:
    """The network for the candidates of ``read``; None if they are too few of a label.

    It starts with FIT_ROWS distinct candidates of each label at most, those of the smallest hashes; if there are more, ROUNDS
    over all follow. Thresholds and calibration come from the whole held fold.
    """
    each = read.select(F.explode("__read.candidates").alias("c")).select("c.secret", "c.before", "c.value", "c.after")
    distinct = written(each.distinct().withColumn("hash", F.xxhash64("before", "value", "after")), "labelled")
    number = {r.secret: r.n for r in distinct.groupBy("secret").agg(F.count("*").alias("n")).collect()}
    if min(number.get(True, 0), number.get(False, 0)) < FEWEST:
        return None
    slices = written(_sliced(distinct, number), "slices")
    train, held = (slices.filter(F.col("held") == on).select("slice", "examples") for on in (False, True))
    examples = train.select(F.inline("examples"))
    rows = []
    for label in (True, False):
        rows += examples.filter(F.col("secret") == label).orderBy("hash", "before", "value", "after").limit(FIT_ROWS).collect()
    first = [(r.before, r.value, r.after) for r in rows]
    secret = np.array([r.secret for r in rows])
    spare = [x for x, s in zip(first, secret, strict=True) if not s]
    model = Network.fresh()
    adam = model.train(first, secret)
    sizes = {r.secret: r.n for r in examples.groupBy("secret").agg(F.count("*").alias("n")).collect()}
    if max(sizes.values()) > FIT_ROWS:
        total = sum(sizes.values())
        share = {label: 0.5 * total / size for label, size in sizes.items()}
        for k in range(ROUNDS):
            slopes = _slopes_of_all(train, model, share, spare, k)
            adam.step(model.weights, {name: slope / total for name, slope in slopes.items()})
    calibrate(model, written(_read_moved(held, model, spare), "held"), number[True] / number[False])
    return model


def _judged(model: Network | None, read: Column, spark) -> Column:
    """Spans of base findings and of added ones, and the digest of the base ones."""
    sent = spark.sparkContext.broadcast(model)
    kind = T.StructType(
        [T.StructField("spans", T.StringType()), T.StructField("base_sha256", T.StringType()), T.StructField("n_model", T.LongType())]
    )

    @F.arrow_udf(kind)
    def judged(read: pa.Array) -> pa.Array:
        network = sent.value
        out = []
        for rows in _batches(read.to_pylist()):
            ordinary = [(i, c) for i, r in enumerate(rows) for c in r["candidates"] if not c["secret"]]
            added: list[list[tuple[int, int, int]]] = [[] for _ in rows]
            if network is not None and ordinary:
                chance = network.probability([_codes(c["before"], c["value"], c["after"]) for _, c in ordinary])
                for (i, c), p in zip(ordinary, chance.tolist(), strict=True):
                    if p >= network.thresholds[_hexadecimal(c["value"])]:
                        added[i].append((c["start"], c["start"] + len(c["value"]), len(RULES)))
            for r, more in zip(rows, added, strict=True):
                base = [tuple(x) for x in r["base"]]
                spans = sorted(base + more, key=lambda x: (x[0], x[2]))
                out.append({"spans": _line(spans), "base_sha256": hashlib.sha256(_line(base).encode()).hexdigest(), "n_model": len(more)})
        return pa.array(out, type=pa.struct([("spans", pa.string()), ("base_sha256", pa.string()), ("n_model", pa.int64())]))

    return judged(read)


def _batches(rows: list[dict], most: int = 2048) -> Iterator[list[dict]]:
    """Rows in lists of about so many candidates."""
    some, held = [], 0
    for r in rows:
        some.append(r)
        held += len(r["candidates"])
        if held >= most:
            yield some
            some, held = [], 0
    if some:
        yield some


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _of_kind(base: Column, kind: int) -> Column:
    """How many findings are of a kind. The function has one argument: Spark gives a second the place in the array."""
    return F.size(F.filter(base, lambda x: x[2] == kind)).cast("long")


_OWN = ["n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_assign, n_access, n_hex, n_model, base_sha256 and spans.

    A span is kind:start:end of the whole match, in code points, end exclusive; spans are sorted by start, then kind,
    and joined by commas. base_sha256 is the digest of those of the rules, also if there are none. Null counts as
    empty: no findings. Rows that repeat are scanned alike; where the table has fewer than FEWEST distinct secrets or
    ordinary candidates, nothing is added to the rules. Columns of these names are replaced, all others kept; no rows
    give no rows.
    """
    own = without(docs, text, *_OWN).columns
    read = written(docs.select(*own, _read(F.col(text)).alias("__read")), "findings")
    model = fit(read)
    counts = [_of_kind(F.col("__read.base"), k).alias(f"n_{kind}") for k, kind in enumerate(RULES)]
    out = read.select(*own, *counts, _judged(model, F.col("__read"), docs.sparkSession).alias("__judged"))
    return out.select(*own, *_OWN[:3], *(F.col(f"__judged.{c}").alias(c) for c in _OWN[3:]))
