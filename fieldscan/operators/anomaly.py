"""Unsupervised spectral anomaly score, one model per scene.

Scenes are independent populations, so every step is keyed by scene. Scaler and components
come from sums over all rows, the trees from their own draws out of all rows. Rows are scored where
they lie, with the models sent to the workers while their measured size allows, and else in chunks
of bounded size, so a scene holding most of the rows still spreads over the cluster.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fieldscan import constants as C
from fieldscan.operators.lookup import lookup_join
from fieldscan.operators.quantiles import join_groups, robust_statistics
from fieldscan.operators.ranks import spearman
from fieldscan.operators.spectra import GROUPS_HELD, fit_scaler, matrices, matrix_of, places
from fieldscan.session import checkpointed

CHUNK_ROWS = 50_000
#: Models up to this size, as JSON text, are sent to every worker.
MODEL_BYTES = 64 << 20
#: Rows that step down all trees of a model at once.
ROWS_AT_ONCE = 2_048
#: Modulus of the rows' draws: products of two numbers below it, twice, stay in 64 bits.
DRAW_PRIME = 2**31 - 1
TREES_PER_GROUP = 20
EULER_GAMMA = 0.5772156649015329


def complete_spectra(scanned: DataFrame, audit: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pixel_id, spectrum): retained bands in order, complete pixels only."""
    bands = audit.groupBy(*keys).agg(F.count_if("retained").alias("_bands"))
    retained = audit.where("retained").select(*keys, "band_index")
    point = F.struct("band_index", F.col("valid_reflectance").alias("v"))
    folded = scanned.join(retained, [*keys, "band_index"]).where(F.col("valid_reflectance").isNotNull()) \
        .groupBy(*keys, "pixel_id").agg(F.array_sort(F.collect_list(point)).alias("points"))
    return folded.join(bands, keys).where(F.size("points") == F.col("_bands")) \
        .select(*keys, "pixel_id", F.transform("points", lambda p: p["v"]).alias("spectrum"))


def _renewed(frame: DataFrame) -> DataFrame:
    """The same columns under new identities: both sides of a cogroup share their origin."""
    return frame.select(*[F.col(c).alias(c) for c in frame.columns])


def band_covariance(spectra: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, j, n, covariance) of the bands i >= j over all rows, as population covariance.

    Each task folds its rows to one centred product matrix per group, so what is shuffled grows
    with the tasks and the squared number of bands, not with the rows.
    """
    schema = T.StructType([*[spectra.schema[k] for k in keys], T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()),
                           T.StructField("n", T.LongType()), T.StructField("mean_i", T.DoubleType()),
                           T.StructField("mean_j", T.DoubleType()), T.StructField("product", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def rows_of(key: tuple, part: tuple) -> pa.RecordBatch:
        n, mean, product = part
        i, j = np.tril_indices(len(mean))
        columns = [*[pa.array([k] * len(i), arrow.field(at).type) for at, k in enumerate(key)], pa.array(i, pa.int32()),
                   pa.array(j, pa.int32()), pa.array(np.full(len(i), n), pa.int64()), pa.array(mean[i]), pa.array(mean[j]),
                   pa.array(product[i, j])]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        for batch in batches:
            for key, values in matrices(batch, len(keys)):
                mean = values.mean(axis=0)
                part = (len(values), mean, (values - mean).T @ (values - mean))
                held[key] = _combined(held[key], part) if key in held else part
            if len(held) > GROUPS_HELD:
                yield from (rows_of(key, part) for key, part in held.items())
                held.clear()
        yield from (rows_of(key, part) for key, part in held.items())

    weighted = {c: F.sum(F.col("n") * F.col(c)) for c in ("mean_i", "mean_j")}
    between = F.sum(F.col("n") * F.col("mean_i") * F.col("mean_j")) - weighted["mean_i"] * weighted["mean_j"] / F.sum("n")
    return spectra.select(*keys, F.col("spectrum").cast("array<double>").alias("spectrum")).mapInArrow(fold, schema) \
        .groupBy(*keys, "i", "j").agg(F.sum("n").alias("n"), ((F.sum("product") + between) / F.sum("n")).alias("covariance"))


def _combined(one: tuple, two: tuple) -> tuple:
    """Row count, mean and centred product matrix of two sets of rows together."""
    n, apart = one[0] + two[0], two[1] - one[1]
    return n, one[1] + apart * (two[0] / n), one[2] + two[2] + np.outer(apart, apart) * (one[0] * two[0] / n)


def fit_components(spectra: DataFrame, scaler: DataFrame, keys: list[str],
                   variance: float = C.PCA_VARIANCE) -> DataFrame:
    """Scaler rows plus components[][] and variance ratios, from all rows.

    Keeps the smallest number of components whose cumulative ratio is strictly above ``variance``.
    A task meets one group's covariance matrix, never its rows.
    """
    schema = T.StructType([*[spectra.schema[k] for k in keys],
                           T.StructField("components", T.ArrayType(T.ArrayType(T.DoubleType()))),
                           T.StructField("ratios", T.ArrayType(T.DoubleType()))])

    def components(cells: pd.DataFrame) -> pd.DataFrame:
        i, j = cells["i"].to_numpy(), cells["j"].to_numpy()
        matrix = np.zeros((i.max() + 1, i.max() + 1))
        matrix[i, j] = matrix[j, i] = cells["covariance"].to_numpy()
        scale = np.sqrt(np.diag(matrix))
        if not (scale > 0).all():
            raise ValueError("a fitting band has zero variance")
        spread, axes = np.linalg.eigh(matrix / np.outer(scale, scale))
        spread, axes = np.clip(spread[::-1], 0, None), axes[:, ::-1].T
        ratios = spread / spread.sum()
        kept = int(np.searchsorted(np.cumsum(ratios), variance, side="right")) + 1
        axes = axes[:kept] * np.sign(axes[np.arange(kept), np.abs(axes[:kept]).argmax(axis=1)])[:, None]
        out = cells[keys].iloc[[0]].copy()
        out["components"], out["ratios"] = [axes.tolist()], [ratios[:kept].tolist()]
        return out

    fitted = band_covariance(spectra, keys).groupBy(*keys).applyInPandas(components, schema)
    return join_groups(scaler, fitted, keys, "inner")


def component_residuals(cells: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, component, residual, length): how far correlation times axis is from share times axis, and the axis' length.

    ``cells`` are those of ``band_covariance``. A share of the variance times the number of bands is the
    eigenvalue, so a fitted component has residual 0 and length 1. Joins of cells with axes by band; no
    task holds a matrix.
    """
    spread = cells.where("i = j").select(*keys, F.col("i").alias("band"), F.sqrt("covariance").alias("sd"))
    whole = cells.select(*keys, "i", "j", "covariance").union(cells.where("i <> j").select(*keys, F.col("j"), F.col("i"), "covariance"))
    scaled = whole.join(spread.select(*keys, F.col("band").alias("i"), F.col("sd").alias("sd_i")), [*keys, "i"]) \
        .join(spread.select(*keys, F.col("band").alias("j"), F.col("sd").alias("sd_j")), [*keys, "j"]) \
        .select(*keys, "i", "j", (F.col("covariance") / (F.col("sd_i") * F.col("sd_j"))).alias("r"))
    axes = model.select(*keys, F.size("mean").alias("bands"), F.posexplode(F.arrays_zip("components", "ratios")).alias("component", "a")).select(
        *keys, "bands", "component", F.col("a.ratios").alias("ratio"), F.posexplode("a.components").alias("j", "v"))
    turned = scaled.join(axes, [*keys, "j"]).groupBy(*keys, "component", "i").agg(F.sum(F.col("r") * F.col("v")).alias("turned"))
    both = turned.join(axes.withColumnRenamed("j", "i"), [*keys, "component", "i"])
    return both.groupBy(*keys, "component").agg(
        F.max(F.abs(F.col("turned") - F.col("ratio") * F.col("bands") * F.col("v"))).alias("residual"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))


def unit_draws(seed: int, tree: int, node: int) -> tuple[float, float]:
    """Two numbers in [0, 1) for a node (1 is the root, 2n and 2n + 1 are the sides of n), from an MD5 text."""
    digits = hashlib.md5(f"{seed}:{tree}:{node}".encode()).hexdigest()
    return int(digits[:8], 16) / 2**32, int(digits[8:16], 16) / 2**32


def grow_tree(points: np.ndarray, seed: int, tree: int, height: int) -> dict[str, list]:
    """One isolation tree as parallel node arrays; feature -1 marks a leaf.

    A node's feature is drawn among those that vary in its rows, its threshold between their least and
    largest value, both from ``unit_draws``; a value up to the threshold goes left. All nodes of a level
    are split together.
    """
    nodes = {"feature": [-1], "threshold": [0.0], "left": [-1], "right": [-1], "size": [len(points)]}
    open_nodes, sizes, order = [(0, 1)], np.array([len(points)]), np.arange(len(points))
    for _ in range(height):
        if not open_nodes:
            break
        values, place, starts = points[order], np.arange(len(open_nodes)), np.cumsum(sizes) - sizes
        low, high = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
        varies = high > low
        draws = np.array([unit_draws(seed, tree, number) for _, number in open_nodes])
        nth = (draws[:, 0] * varies.sum(axis=1)).astype(int)
        feature = (varies.cumsum(axis=1) > nth[:, None]).argmax(axis=1)
        threshold = low[place, feature] + draws[:, 1] * (high[place, feature] - low[place, feature])
        owner = np.repeat(place, sizes)
        goes_left = values[np.arange(len(order)), feature[owner]] <= threshold[owner]
        lefts = np.bincount(owner, goes_left, len(place)).astype(int)
        splits = varies.any(axis=1) & (lefts > 0) & (lefts < sizes)
        following = []
        for at in np.flatnonzero(splits).tolist():
            me, number = open_nodes[at]
            first = len(nodes["size"])
            nodes["feature"][me], nodes["threshold"][me] = int(feature[at]), float(threshold[at])
            nodes["left"][me], nodes["right"][me] = first, first + 1
            for child, size in enumerate((int(lefts[at]), int(sizes[at] - lefts[at]))):
                following.append((first + child, 2 * number + child))
                for name, value in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("size", size)):
                    nodes[name].append(value)
        stay = splits[owner]
        side = 2 * owner[stay] + ~goes_left[stay]
        order = order[stay][np.argsort(side, kind="stable")]
        open_nodes, sizes = following, np.array([nodes["size"][at] for at, _ in following])
    return nodes


def average_path(size: np.ndarray | int) -> np.ndarray:
    """Expected depth of an unsuccessful search among ``size`` points."""
    n = np.atleast_1d(np.asarray(size, dtype=float))
    safe = np.maximum(n, 3.0)
    deep = 2.0 * (np.log(safe - 1.0) + EULER_GAMMA) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, deep))


def tree_factors(seed: int, trees: int) -> list[tuple[int, int, int, int]]:
    """(tree, first, second, third) of the rows' draws, below DRAW_PRIME, from MD5 texts."""
    out = []
    for tree in range(trees):
        digits = hashlib.md5(f"{seed}:{tree}".encode()).hexdigest()
        out.append((tree, *[1 + int(digits[at:at + 8], 16) % (DRAW_PRIME - 1) for at in (0, 8, 16)]))
    return out


def drawn_rows(spectra: DataFrame, keys: list[str], trees: int, samples: int, seed: int) -> DataFrame:
    """(keys, pixel_id, spectrum, tree, population): for each tree ``samples`` rows of the whole group, all of a smaller one.

    A row's identity is hashed once to two numbers; a tree's draw combines them with the tree's factors
    modulo a prime. Only rows with a surviving draw leave the scan, about four times as many as needed,
    of which exactly ``samples`` stay by the order of their draws: no replacement, and the same rows
    under any partitioning. Fewer survivors than needed fail the job; 256 are 24 standard deviations
    below the expected 1024.
    """
    sizes = checkpointed(spectra.groupBy(*keys).agg(F.count(F.lit(1)).alias("population")))
    known = sizes.agg(F.count(F.lit(1)).alias("groups"), F.sum("population").alias("weight")).first()
    counted = lookup_join(spectra.select(*keys, "pixel_id", "spectrum"), sizes, keys, "population",
                          known["groups"], known["weight"] or 0)
    digits = F.md5(F.col("pixel_id").cast("string"))
    number = lambda at: F.pmod(F.conv(F.substring(digits, at, 13), 16, 10).cast("bigint"), F.lit(DRAW_PRIME))
    factors = np.array(tree_factors(seed, trees), np.int64)
    schema = T.StructType([*[spectra.schema[c] for c in (*keys, "pixel_id")], T.StructField("spectrum", T.ArrayType(T.DoubleType())),
                           T.StructField("population", T.LongType()), T.StructField("tree", T.IntegerType()), T.StructField("draw", T.LongType())])
    arrow = to_arrow_schema(schema)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                x, y, population = (batch.column(batch.num_columns - n).to_numpy()[:, None] for n in (2, 1, 3))
                draws = (factors[:, 1] * x + factors[:, 2] * y + factors[:, 3]) % DRAW_PRIME
                row, tree = np.nonzero(draws < 4.0 * samples * DRAW_PRIME / population)
                kept = [batch.column(n).take(pa.array(row)) for n in range(batch.num_columns - 2)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(tree.astype(np.int32)), pa.array(draws[row, tree])], schema=arrow)

    chosen = counted.select(*keys, "pixel_id", F.col("spectrum").cast("array<double>").alias("spectrum"), "population",
                            number(1).alias("_x"), number(14).alias("_y")).mapInArrow(draw, schema)
    order = Window.partitionBy(*keys, "tree").orderBy("draw", "pixel_id")
    return chosen.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= samples).drop("draw", "_place")


def fit_forest(points: DataFrame, keys: list[str], trees: int = C.FOREST_TREES, samples: int = C.FOREST_SAMPLES,
               seed: int = C.MODEL_SEED, model: DataFrame | None = None) -> DataFrame:
    """(keys, trees[], sample_size): isolation trees over the column ``spectrum``, grown TREES_PER_GROUP to a task.

    With a ``model`` of mean, scale and components the drawn rows are projected first.
    """
    drawn = drawn_rows(points, keys, trees, samples, seed)
    if model is not None:
        extra = ["pixel_id", "tree", "population"]
        drawn = apply_models(drawn, model.select(*keys, "mean", "scale", "components"), keys, extra, "spectrum", project,
                             T.StructField("spectrum", T.ArrayType(T.DoubleType())))
    part = F.floor(F.col("tree") / TREES_PER_GROUP)
    node = T.StructType([
        *[points.schema[k] for k in keys], T.StructField("tree", T.IntegerType()),
        T.StructField("sample_size", T.LongType()), T.StructField("feature", T.ArrayType(T.IntegerType())),
        T.StructField("threshold", T.ArrayType(T.DoubleType())), T.StructField("left", T.ArrayType(T.IntegerType())),
        T.StructField("right", T.ArrayType(T.IntegerType())), T.StructField("size", T.ArrayType(T.IntegerType()))])

    arrow = to_arrow_schema(node)

    def grow(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        matrix = matrix_of(group["spectrum"].chunk(0), np.arange(len(group)))
        tree_of, population = group["tree"].to_numpy(), group["population"][0].as_py()
        wanted, out = min(samples, population), []
        for tree in np.unique(tree_of).tolist():
            rows = np.flatnonzero(tree_of == tree)
            if len(rows) != wanted:
                raise ValueError(f"a tree drew {len(rows)} of {wanted} rows")
            nodes = grow_tree(matrix[rows], seed, tree, max(1, math.ceil(math.log2(wanted))))
            out.append({**{k: group[k][0].as_py() for k in keys}, "tree": tree, "sample_size": wanted, **nodes})
        return pa.Table.from_pylist(out, schema=arrow)

    grown = drawn.withColumn("part", part).groupBy(*keys, "part").applyInArrow(grow, node)
    return grown.groupBy(*keys).agg(F.max("sample_size").alias("sample_size"), F.array_sort(F.collect_list(
        F.struct("tree", "feature", "threshold", "left", "right", "size"))).alias("trees"))


def fit_anomaly(spectra: DataFrame, keys: list[str], seed: int = C.MODEL_SEED, trees: int = C.FOREST_TREES) -> DataFrame:
    """One model row per scene, fitted on all its rows. Only spectra enter; no label, score or weight can."""
    model = checkpointed(fit_components(spectra, fit_scaler(spectra, keys), keys))
    return checkpointed(join_groups(model, fit_forest(spectra, keys, trees, seed=seed, model=model), keys, "inner"))


def project(values: np.ndarray, model: dict) -> np.ndarray:
    """Rows in component space."""
    standard = (values - np.asarray(model["mean"], dtype=float)) / np.asarray(model["scale"], dtype=float)
    return standard @ np.asarray([list(c) for c in model["components"]], dtype=float).T


def score_points(points: np.ndarray, model: dict) -> np.ndarray:
    """2 ** -(mean path length / expected path length); higher is more unusual. All trees step down together."""
    trees = model["trees"]
    sizes = [len(tree["feature"]) for tree in trees]
    roots = np.cumsum(sizes) - sizes
    join = lambda name: np.concatenate([np.asarray(tree[name]) for tree in trees])
    shift = np.repeat(roots, sizes)
    feature, threshold, left, right = join("feature"), join("threshold"), join("left") + shift, join("right") + shift
    leaf = average_path(join("size"))
    expected = max(float(average_path(model["sample_size"])[0]), np.finfo(float).tiny)
    total = np.empty(len(points))
    for start in range(0, len(points), ROWS_AT_ONCE):
        rows = points[start:start + ROWS_AT_ONCE]
        at = np.tile(roots, (len(rows), 1))
        depth = np.zeros(at.shape)
        who, which = np.nonzero(feature[at] >= 0)
        while len(who):
            here = at[who, which]
            at[who, which] = np.where(rows[who, feature[here]] <= threshold[here], left[here], right[here])
            depth[who, which] += 1
            moving = feature[at[who, which]] >= 0
            who, which = who[moving], which[moving]
        total[start:start + ROWS_AT_ONCE] = (depth + leaf[at]).sum(axis=1)
    return np.exp2(-total / len(trees) / expected)


def apply_models(rows: DataFrame, models: DataFrame, keys: list[str], extra: list[str], values: str,
                 function: Callable[[np.ndarray, dict], np.ndarray], out: T.StructField) -> DataFrame:
    """(keys, extra, out): ``function`` of each group's rows of ``values`` (double arrays) and its model row.

    Models of MODEL_BYTES at most, as measured, are sent to all workers and rows stay where they lie.
    Beyond, a group is cut by hash into chunks of about CHUNK_ROWS rows and its model copied to each.
    """
    schema = T.StructType([*[rows.schema[c] for c in (*keys, *extra)], out])
    wanted = rows.select(*keys, F.col(values).cast("array<double>").alias(values), *extra)
    models = checkpointed(models)
    text = F.sum(F.length(F.to_json(F.struct(*[c for c in models.columns if c not in keys]))).cast("bigint"))
    if (models.agg(text).first()[0] or 0) > MODEL_BYTES:
        return _apply_by_chunk(wanted, models, keys, extra, values, function, schema)
    known = {tuple(row[k] for k in keys): row.asDict(recursive=True) for row in models.collect()}
    sent = rows.sparkSession.sparkContext.broadcast(known)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = {key: at for key, at in places(batch, len(keys)).items() if key in sent.value}
            found = {key: function(matrix_of(batch.column(len(keys)), at), sent.value[key]) for key, at in spots.items()}
            if not found:
                continue
            order = pa.array(np.concatenate(list(spots.values())))
            result = pa.array([v for part in found.values() for v in part.tolist()], arrow.field(out.name).type)
            kept = [batch.column(n).take(order) for n in range(batch.num_columns) if n != len(keys)]
            yield pa.RecordBatch.from_arrays([*kept, result], schema=arrow)

    return wanted.mapInArrow(run, schema)


def _apply_by_chunk(rows: DataFrame, models: DataFrame, keys: list[str], extra: list[str], values: str,
                    function: Callable[[np.ndarray, dict], np.ndarray], schema: T.StructType) -> DataFrame:
    sizes = checkpointed(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    summary = sizes.agg(F.count(F.lit(1)).alias("groups"), F.sum("_n").alias("weight")).first()
    chunks = F.ceil(F.col("_n") / F.lit(CHUNK_ROWS))
    placed = lookup_join(rows, sizes, keys, "_n", summary["groups"], summary["weight"] or 0) \
        .withColumn("chunk", F.pmod(F.xxhash64(*extra), chunks)).drop("_n")
    copies = join_groups(models, sizes, keys, "inner") \
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1))).drop("_n")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        result = left[[*keys, *extra]].copy()
        found = function(np.asarray(left[values].tolist(), dtype=float), right.iloc[0].to_dict()).tolist() if len(left) and len(right) else []
        result = result.iloc[:len(found)]
        result[schema[-1].name] = found
        return result

    by = [*keys, "chunk"]
    return placed.groupBy(*by).cogroup(_renewed(copies).groupBy(*by)).applyInPandas(run, schema)


def score_anomaly(spectra: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pixel_id, anomaly_score) of every spectrum; a model without components scores the spectra as they are."""
    axes = "components" in model.columns

    def score(values: np.ndarray, row: dict) -> np.ndarray:
        return score_points(project(values, row) if axes else values, row)

    return apply_models(spectra, model, keys, ["pixel_id"], "spectrum", score, T.StructField("anomaly_score", T.DoubleType()))


def component_table(model: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, component, ratio, cumulative): variance shares with their running sum."""
    order = Window.partitionBy(*keys).orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return model.select(*keys, F.posexplode("ratios").alias("component", "ratio")) \
        .withColumn("cumulative", F.sum("ratio").over(order))


def compare_with_risk(scores: DataFrame, evidence: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Post-fit context on the same pixels: Spearman, and statistics per risk class.

    All four classes appear; a class without pixels has count 0 and NULLs.
    """
    paired = scores.join(evidence.select(*keys, "pixel_id", "risk_score", "risk_class"), [*keys, "pixel_id"])
    classes = scores.select(*keys).distinct().withColumn("risk_class", F.explode(F.array(*[F.lit(c) for c in range(1, 5)])))
    by_class = robust_statistics(paired, [*keys, "risk_class"], ["anomaly_score"]).drop("measure")
    return (spearman(paired, keys, "anomaly_score", "risk_score"),
            join_groups(classes, by_class, [*keys, "risk_class"]).fillna(0, subset=["count"]))
