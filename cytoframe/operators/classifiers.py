"""All classifiers of a comparison in few plans: every probe, feature set and setting at once.

The cells are one table with one vector of all features; a feature set is a list of places in it. All
logistic models take their Newton steps together: one pass over the training rows gives each model's loss,
gradient and curvature per partition, they are summed by model, and the step is solved where the sum is; the
driver sees one small row a model and round. Forests are grown once per probe and feature set to the
greatest depth, and the shallower ones are read off by cutting their trees. Neighbours of all probes and sets come from one
search at the largest k. Predictions of all fitted models come from one pass over all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoframe.operators.columns import quoted
from cytoframe.operators.neighbours import nearest_vectors
from cytoframe.operators.ranks import sequential_index
from cytoframe.operators.reshape import stack
from cytoframe.operators.resample import hash_number
from cytoframe.session import _ensure_checkpoint_dir, broadcast_within, materialise

NEWTON_ROUNDS = 60
GRADIENT = 1e-8  # of the largest entry at the start


def cell_vectors(
    splits: Mapping[str, DataFrame], features: Sequence[str], y: str, key: str, probe: str | None, fit_on: str
) -> DataFrame:
    """(split, probe, key, y, x, weight) of all splits; weight = n / (classes x rows of the class) of the probe's training rows."""
    parts = [
        df.select(
            F.lit(name).alias("split"),
            (F.coalesce(quoted(probe).cast("string"), F.lit("")) if probe else F.lit("all")).alias("probe"),
            quoted(key).alias("key"), quoted(y).cast("int").alias("y"),
            F.array(*[quoted(f).cast("double") for f in features]).alias("x"),
        )
        for name, df in splits.items()
    ]
    rows = materialise(stack(parts))
    counts = rows.where((F.col("split") == fit_on) & F.col("y").isNotNull()).groupBy("probe", "y").agg(F.count("*").alias("c"))
    totals = counts.groupBy("probe").agg(F.sum("c").alias("n"), F.count("*").alias("classes"))
    weights = counts.join(totals, "probe").select("probe", "y", (F.col("n") / (F.col("classes") * F.col("c"))).alias("weight"))
    return materialise(rows.join(broadcast_within(weights), ["probe", "y"], "left"))


def _softmax(scores: np.ndarray) -> np.ndarray:
    shifted = np.exp(scores - scores.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def _rows(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _partial(x: np.ndarray, at: np.ndarray, weight: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature of the weighted softmax loss, end to end. ``theta`` is classes x (features + 1)."""
    classes, width = theta.shape
    p = _softmax(x @ theta.T)
    loss = -(weight * np.log(np.maximum(p[np.arange(len(at)), at], 1e-300))).sum()
    rest = p.copy()
    rest[np.arange(len(at)), at] -= 1
    gradient = (rest * weight[:, None]).T @ x
    curvature = np.empty((classes, width, classes, width))
    for a in range(classes):
        for b in range(a, classes):
            w = weight * p[:, a] * ((a == b) - p[:, b])
            curvature[a, :, b, :] = (x * w[:, None]).T @ x
            curvature[b, :, a, :] = curvature[a, :, b, :].T
    return np.concatenate([[loss], gradient.ravel(), curvature.ravel()])


def _newton(total: np.ndarray, theta: np.ndarray, penalty: float) -> tuple[float, float, np.ndarray]:
    """Penalised loss, largest entry of the gradient and the Newton step, from summed partials (slopes are penalised, intercepts not)."""
    classes, width = theta.shape
    n = classes * width
    slopes = np.ones((classes, width))
    slopes[:, -1] = 0
    loss = total[0] + 0.5 * penalty * float((theta * slopes * theta).sum())
    gradient = total[1 : 1 + n] + penalty * (slopes * theta).ravel()
    curvature = total[1 + n :].reshape(n, n) + penalty * np.diag(slopes.ravel())
    # the same number added to all intercepts changes nothing: keep their sum at rest
    free = np.zeros((classes, width))
    free[:, -1] = 1
    curvature += np.outer(free, free) * (np.trace(curvature) / n + 1e-12)
    return loss, float(np.abs(gradient).max()), -np.linalg.lstsq(curvature, gradient, rcond=None)[0]


def logistic_models(
    train: DataFrame, sets: Mapping[str, Sequence[int]], classes: Mapping[str, Sequence[int]], strengths: Sequence[float]
) -> dict[tuple[str, str, float], np.ndarray]:
    """Multinomial weights (classes x (features + 1), intercept last) by (probe, set, C).

    Minimises the balanced log loss plus |slopes|^2 / (2 C); one job a round serves all models that still move.
    """
    models = [(p, s, c) for p in classes for s in sets for c in strengths]
    theta = {m: np.zeros((len(classes[m[0]]), len(sets[m[1]]) + 1)) for m in models}
    accepted = {m: (np.inf, theta[m], None, 1.0) for m in models}  # loss, weights, step, share of it tried now
    start: dict = {}
    moving = list(models)
    for _ in range(NEWTON_ROUNDS):
        if not moving:
            break
        trial = {i: (m, theta[m]) for i, m in enumerate(moving)}

        def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                x = np.hstack([_rows(batch), np.ones((len(batch), 1))])
                probe = np.array(batch.column("probe").to_pylist(), dtype=object)
                y, weight = batch.column("y").to_numpy(), batch.column("weight").to_numpy()
                for i, ((p, s, _), now) in trial.items():
                    here = probe == p
                    if here.any():
                        at = np.searchsorted(np.array(classes[p]), y[here])
                        made = _partial(x[here][:, [*sets[s], -1]], at, weight[here], now)
                        sums[i] = sums[i] + made if i in sums else made
            if sums:
                yield pa.RecordBatch.from_pydict(
                    {"model": pa.array(list(sums), pa.int32()), "sums": pa.array([v for v in sums.values()], pa.list_(pa.float64()))}
                )

        def steps(table: pa.Table) -> pa.Table:
            i = table.column("model")[0].as_py()
            total = np.sum([np.asarray(v.values) for v in table.column("sums")], axis=0)
            (_, _, c), now = trial[i]
            loss, gradient, step = _newton(total, now, 1.0 / c)
            return pa.table({"model": pa.array([i], pa.int32()), "loss": [loss], "gradient": [gradient], "step": pa.array([step], pa.list_(pa.float64()))})

        made = train.select("probe", "y", "x", "weight").mapInArrow(partials, "model int, sums array<double>")
        still = []
        for r in made.groupBy("model").applyInArrow(steps, "model int, loss double, gradient double, step array<double>").collect():
            m = moving[r["model"]]
            loss, old, step, share = accepted[m]
            start.setdefault(m, max(r["gradient"], 1e-300))
            if r["loss"] <= loss * (1 + 1e-14) or share < 1e-9:
                step = np.array(r["step"]).reshape(theta[m].shape)
                accepted[m] = (r["loss"], theta[m], step, 1.0)
                if r["gradient"] <= GRADIENT * start[m]:
                    continue
                theta[m] = theta[m] + step
            else:  # too far: try half of the last step
                accepted[m] = (loss, old, step, share / 2)
                theta[m] = old + step * share / 2
            still.append(m)
        moving = still
    return {m: accepted[m][1] for m in models}


class Trees:
    """A forest as flat arrays: node i of tree t splits on ``feature`` (-1: leaf) at ``limit``; ``share`` are its class shares."""

    def __init__(self, nodes, features: Sequence[int]) -> None:
        nodes = nodes.sort_values(["treeID", "id"])
        size = nodes.groupby("treeID", sort=True).size().to_numpy()
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        offset = np.repeat(first, size)
        self.roots = first
        split = nodes["feature"].to_numpy()
        self.feature = np.where(split >= 0, np.array([*features, 0])[split], -1)
        self.limit = nodes["limit"].to_numpy()
        self.left = nodes["left"].to_numpy() + offset
        self.right = nodes["right"].to_numpy() + offset
        stats = np.array(nodes["stats"].tolist())
        self.share = stats / stats.sum(axis=1, keepdims=True)

    def predict(self, x: np.ndarray, depths: Sequence[int]) -> dict[int, np.ndarray]:
        """Class places by the trees cut at each depth: a row stops at the node that it has reached there."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        found = {}
        rows = np.arange(len(x))[:, None]
        for depth in range(1, max(depths, default=0) + 1):
            feature = self.feature[at]
            goes = x[rows, np.maximum(feature, 0)] <= self.limit[at]
            at = np.where(feature < 0, at, np.where(goes, self.left[at], self.right[at]))
            if depth in depths:
                found[depth] = self.share[at].sum(axis=1).argmax(axis=1)
        return found


def grown_forests(
    train: DataFrame, sets: Mapping[str, Sequence[int]], classes: Mapping[str, Sequence[int]], depth: int, trees: int, seed: int
) -> dict[tuple[str, str], Trees]:
    """One forest per (probe, set), grown to ``depth``; a few fits run at a time and share the executors."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    spark = train.sparkSession
    _ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/forests-{uuid.uuid4().hex}"

    def grow(task) -> tuple[tuple[str, str], Trees]:
        number, (probe, name) = task
        place = F.coalesce(*[F.when(F.col("y") == c, float(i)) for i, c in enumerate(classes[probe])])
        ready = train.where(F.col("probe") == probe).select(
            place.alias("__y__"), "weight", array_to_vector(F.array(*[F.col("x")[i] for i in sets[name]])).alias("__x__")
        )
        fitted = RandomForestClassifier(
            featuresCol="__x__", labelCol="__y__", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=1024
        ).fit(ready)
        path = f"{folder}/{number}"
        fitted.write().save(path)
        n = F.col("nodeData")
        nodes = spark.read.parquet(f"{path}/data").select(
            "treeID", n["id"].alias("id"), n["split"]["featureIndex"].alias("feature"),
            F.coalesce(F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)), F.lit(0.0)).alias("limit"),
            n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["impurityStats"].alias("stats"),
        )
        # at most trees x 2^(depth + 1) nodes, whatever the number of rows
        return (probe, name), Trees(nodes.toPandas(), sets[name])

    tasks = list(enumerate((p, s) for p in classes for s in sets))
    with ThreadPoolExecutor(max_workers=4) as pool:
        return dict(pool.map(grow, tasks))


def fitted_predictions(rows: DataFrame, sets, classes, logistic, forests, depths: Sequence[int]) -> DataFrame:
    """(split, probe, features, classifier, key, true, pred) of all logistic models and forests, in one pass."""
    kind = dict(rows.dtypes)["key"]
    models = rows.sparkSession.sparkContext.broadcast((dict(sets), dict(classes), logistic, forests))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets_, classes_, logistic_, forests_ = models.value
        for batch in batches:
            x = _rows(batch)
            probe = np.array(batch.column("probe").to_pylist(), dtype=object)
            for p in np.unique(probe):
                at = np.flatnonzero(probe == p)
                if p not in classes_:
                    continue
                place, here = pa.array(at), x[at]
                labels = np.array(classes_[p])
                fixed = [batch.column(c).take(place) for c in ("split", "probe", "key", "y")]
                made = []
                for (q, s, c), theta in logistic_.items():
                    if q == p:
                        scores = here[:, list(sets_[s])] @ theta[:, :-1].T + theta[:, -1]
                        made.append((s, f"Logistic Regression C={c:g}", scores.argmax(axis=1)))
                for (q, s), trees in forests_.items():
                    if q == p:
                        made += [(s, f"Random Forest depth = {d}", v) for d, v in trees.predict(here, depths).items()]
                for s, name, v in made:
                    yield pa.RecordBatch.from_arrays(
                        [fixed[0], fixed[1], pa.array([s] * len(at)), pa.array([name] * len(at)), fixed[2], fixed[3],
                         pa.array(labels[v], pa.int32())],
                        names=["split", "probe", "features", "classifier", "key", "true", "pred"],
                    )

    return rows.select("split", "probe", "key", "y", "x").mapInArrow(
        predict, f"split string, probe string, features string, classifier string, key {kind}, true int, pred int"
    )


def _in_sets(predicted: DataFrame, sets) -> DataFrame:
    return predicted.withColumn("features", F.explode(F.array(*[F.lit(s) for s in sets])))


def dummy_predictions(rows: DataFrame, fit_on: str, strategies: Sequence[str], seed: int) -> DataFrame:
    """Constant predictions, or classes drawn by the key's hash: (split, probe, classifier, key, true, pred).

    A draw picks a training row (stratified) or a class (uniform) by its number in its probe, so any number of
    classes is joined by equality.
    """
    train = rows.where((F.col("split") == fit_on) & F.col("y").isNotNull())
    asked = rows.select("split", "probe", "key", "y")
    out = []
    constant = [s for s in strategies if s in ("most_frequent", "prior")]
    if constant:
        counts = train.groupBy("probe", "y").agg(F.count("*").alias("c"))
        most = counts.groupBy("probe").agg(F.max_by("y", F.struct("c", -F.col("y"))).alias("pred"))
        named = F.explode(F.array(*[F.lit(f"Dummy {s}") for s in constant]))
        out.append(asked.join(broadcast_within(most), "probe").withColumn("classifier", named))
    coin = hash_number(seed, F.col("key")) / F.lit(float(2**52))
    for s in strategies:
        if s not in ("stratified", "uniform"):
            continue
        drawn = train.select("probe", F.col("y").alias("pred"), hash_number(seed + 1, F.col("key")).alias("h"))
        if s == "uniform":
            drawn = drawn.groupBy("probe", "pred").agg(F.min("h").alias("h"))
        numbered = sequential_index(drawn, "h", "number", ["probe"], start=0)
        sizes = numbered.groupBy("probe").agg(F.count("*").alias("n"))
        placed = asked.join(broadcast_within(sizes), "probe").withColumn("number", F.floor(coin * F.col("n")).cast("long"))
        out.append(placed.join(numbered.drop("h"), ["probe", "number"]).withColumn("classifier", F.lit(f"Dummy {s}")))
    return stack([o.select("split", "probe", "classifier", "key", F.col("y").alias("true"), "pred") for o in out])


def _majorities(labels: pa.Array, ks: Sequence[int]) -> list[np.ndarray]:
    """Per k the most frequent of the first k labels of every list, the smaller one on ties; -1 for an empty list."""
    size = labels.value_lengths().to_numpy()
    width = max(1, int(size.max(initial=0)))
    table = np.zeros((len(size), width), dtype="int64")
    table[np.arange(width) < size[:, None]] = labels.flatten().to_numpy()
    found = []
    for k in ks:
        first = table[:, :k]
        there = np.arange(first.shape[1]) < size[:, None]
        votes = ((first[:, :, None] == first[:, None, :]) & there[:, None, :]).sum(axis=2) * there
        most = (votes == votes.max(axis=1, keepdims=True)) & there
        found.append(np.where(most, first, np.iinfo("int64").max).min(axis=1))
        found[-1][size == 0] = -1
    return found


def neighbour_predictions(rows: DataFrame, sets, fit_on: str, ks: Sequence[int], block: int = 2000) -> DataFrame:
    """Votes of the k nearest training rows (the smaller label on ties) for all probes, sets and k from one search.

    The sets are views of one vector, so a pair of rows is visited once for all of them.
    """
    known = rows.where((F.col("split") == fit_on) & F.col("y").isNotNull())
    asked = rows.withColumn("q", F.to_json(F.struct("split", "key"))).withColumn("g", F.col("probe"))
    near = nearest_vectors(
        known.select(F.col("probe").alias("g"), F.col("key").alias("t"), F.col("x").alias("vec"), F.col("y").alias("carry")),
        asked.select("g", "q", F.col("x").alias("vec")),
        max(ks), block=block, views={f"set{i}": places for i, places in enumerate(sets.values())},
    )
    labels = [f"set{i}" for i in range(len(sets))]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.stack([v for n in labels for v in _majorities(batch.column(n), ks)], axis=1)
            ends = pa.array(np.arange(len(batch) + 1) * made.shape[1], pa.int32())
            picked = pa.ListArray.from_arrays(ends, pa.array(made.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("q"), picked], names=["g", "q", "made"])

    voted = near.select("g", "q", *[F.col(n)["carry"].alias(n) for n in labels]).mapInArrow(vote, "g string, q string, made array<int>")
    names = F.array(*[F.struct(F.lit(s).alias("features"), F.lit(f"KNN k={k}").alias("classifier")) for s in sets for k in ks])
    joined = asked.drop("x").join(voted, ["g", "q"]).select("split", "probe", "key", "y", F.posexplode("made").alias("nth", "pred"))
    return joined.select(
        "split", "probe", F.get(names, F.col("nth"))["features"].alias("features"), F.get(names, F.col("nth"))["classifier"].alias("classifier"),
        "key", F.col("y").alias("true"), "pred",
    )


def compared(
    splits: Mapping[str, DataFrame], sets: Mapping[str, Sequence[str]], y: str, key: str, grid: Sequence[dict],
    probe: str | None = None, seed: int = 0, fit_on: str = "train",
) -> DataFrame:
    """(split, probe, features, classifier, key, true, pred) of every classifier of the grid on every set and probe.

    Rows without a label are predicted but not learned from; a probe without training rows gets no predictions. Missing
    features are an error of the caller, as they are for the models.
    """
    used = {name: list(columns) for name, columns in sets.items() if columns}
    features = list(dict.fromkeys(f for columns in used.values() for f in columns))
    place = {f: i for i, f in enumerate(features)}
    at = {name: [place[f] for f in columns] for name, columns in used.items()}
    rows = cell_vectors(splits, features, y, key, probe, fit_on)
    train = rows.where((F.col("split") == fit_on) & F.col("y").isNotNull())
    classes: dict[str, list[int]] = {}
    for r in train.select("probe", "y").distinct().orderBy("probe", "y").collect():
        classes.setdefault(r["probe"], []).append(r["y"])
    by = lambda kind, name: [c[name] for c in grid if c["kind"] == kind]
    out = []
    logistic = logistic_models(train, at, classes, by("logistic", "C")) if by("logistic", "C") else {}
    depths, forests = by("forest", "depth"), {}
    if depths:
        forests = grown_forests(train, at, classes, max(depths), max(by("forest", "trees")), seed)
    if logistic or forests:
        out.append(fitted_predictions(rows, at, classes, logistic, forests, depths))
    if by("knn", "k"):
        out.append(neighbour_predictions(rows, at, fit_on, by("knn", "k")))
    if by("dummy", "strategy"):
        out.append(_in_sets(dummy_predictions(rows, fit_on, by("dummy", "strategy"), seed), at))
    return stack(out).withColumnRenamed("key", key)
