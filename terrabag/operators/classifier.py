"""Distribution classifiers M0 to M3: a representation of bags, a decision kernel and a solver."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrabag.functions.expressions import dot, literal_vector, sigmoid
from terrabag.storage import materialize

from . import kernels as k
from . import stats
from .solvers import LANDMARKS, MAX_DUAL_BAGS, FitResult, KernelLogistic, PrimalLogistic, collect_gram
from .vector_pairs import VectorPairs

#: Valid triples of representation, decision kernel and solver.
METHODS = {("exact_kme", "linear", "dual"): "M0", ("rff", "linear", "primal"): "M1", ("rff", "rbf", "dual"): "M2", ("sliced_wasserstein", "rbf", "dual"): "M3"}


@dataclass(frozen=True)
class ModelSpec:
    """Which model, and the size of its representation."""

    representation: str = "rff"
    decision: str = "linear"
    solver: str = "primal"
    frequencies: int = 128
    projections: int = 64
    quantiles: int = 64
    order: int = 2

    def __post_init__(self):
        if (self.representation, self.decision, self.solver) not in METHODS:
            raise ValueError("no such model: " + "/".join((self.representation, self.decision, self.solver)))
        if self.order != 2 and self.representation == "sliced_wasserstein":
            raise ValueError("the Gaussian kernel needs distances of order 2")

    @property
    def method(self) -> str:
        return METHODS[self.representation, self.decision, self.solver]

    @classmethod
    def m0(cls) -> ModelSpec:
        return cls("exact_kme", "linear", "dual")

    @classmethod
    def m1(cls, frequencies: int = 128) -> ModelSpec:
        return cls("rff", "linear", "primal", frequencies=frequencies)

    @classmethod
    def m2(cls, frequencies: int = 128) -> ModelSpec:
        return cls("rff", "rbf", "dual", frequencies=frequencies)

    @classmethod
    def m3(cls, projections: int = 64, quantiles: int = 64, order: int = 2) -> ModelSpec:
        return cls("sliced_wasserstein", "rbf", "dual", projections=projections, quantiles=quantiles, order=order)

    @classmethod
    def from_legacy(cls, kernel: str, n_rff_features: int = 256, n_projections: int = 100) -> ModelSpec:
        if kernel == "mean_embedding":
            return cls.m1(n_rff_features) if n_rff_features > 0 else cls.m0()
        if kernel == "wasserstein":
            return cls.m3(n_projections)
        raise ValueError(f"unknown kernel type {kernel!r}")


@dataclass
class DistributionClassifier:
    """Fits bags of cells (bag_id, cell_id, label, features) and scores other bags.

    auto_sigma estimates bandwidths from the training cells and bags and leaves out the values given. The exact kernel is rounded to
    three digits by default. Standardisation uses training cells only. Suitability is relative, not a probability.
    """

    spec: ModelSpec
    sigma: float = 1.0
    decision_sigma: float | None = None
    lam: float = 0.1
    scale_features: bool = True
    auto_sigma: bool = True
    seed: int = 42
    round_exact: bool = True
    max_iter: int = 100
    tol: float = 1e-3

    result: FitResult | None = None

    def clone(self) -> DistributionClassifier:
        return replace(self, result=None)

    def _scaled(self, cells: DataFrame) -> DataFrame:
        return stats.zscore(cells, self.width, self.stats) if self.scale_features else cells

    def _represent(self, cells: DataFrame, keep: tuple[str, ...] = ("bag_id",)) -> DataFrame:
        if self.spec.representation == "rff":
            return k.embeddings(cells, self.weights, keep)
        if self.spec.representation == "sliced_wasserstein":
            return k.quantile_rows(cells, self.directions, self.spec.quantiles)
        return cells.select("bag_id", *[c for c in ("cell_id",) if c in cells.columns], "features")

    def _gram(self, left: DataFrame, right: DataFrame | None) -> DataFrame:
        s = self.spec
        if s.representation == "exact_kme":
            return k.exact_gram(left, left if right is None else right, self.sigma_, upper=right is None, decimals=3 if self.round_exact else None)
        return k.vector_distances(left, right)

    def fit(self, cells: DataFrame) -> DistributionClassifier:
        """Fit on all bags of `cells`; the driver holds one number a bag for dual models, and the weights for primal ones."""
        one = cells.select(F.size("features")).first()
        if one is None:
            raise ValueError("no cells to fit on")
        self.width = one[0]
        if self.scale_features:
            row = stats.zscore_stats(cells, self.width).first()
            self.stats = cells.sparkSession.createDataFrame([row])
        x = self._scaled(cells)
        self.sigma_ = float(k.median_cell_distance(x, self.seed).first().sigma) if self.auto_sigma else self.sigma
        if self.spec.representation == "rff":
            self.weights = k.fourier_weights(self.width, self.spec.frequencies, self.sigma_, self.seed)
        elif self.spec.representation == "sliced_wasserstein":
            self.directions = k.unit_directions(self.width, self.spec.projections, self.seed)
        if self.spec.solver == "primal":
            self.result = PrimalLogistic(self.lam, self.max_iter, min(self.tol, 1e-6)).fit(self._represent(x, ("bag_id", "label")), "embedding")
            return self
        labels = cells.groupBy("bag_id").agg(F.max("label").alias("label"))
        if self.spec.decision == "linear":
            labels = labels.limit(MAX_DUAL_BAGS + 1)
        known = {r.bag_id: r.label for r in labels.collect()}
        if len(known) > MAX_DUAL_BAGS and self.spec.decision == "linear":
            raise ValueError(f"a dual model of the exact kernel holds {MAX_DUAL_BAGS} bags at most; more need a primal one")
        ids = sorted(known)
        # Written once, so that fitting and every later prediction read the same rows.
        self.train = materialize(self._represent(x), "train")
        y, solver = np.array([known[b] for b in ids]), KernelLogistic(self.lam, self.max_iter, self.tol)
        self.bag_ids = ids
        given = None if self.auto_sigma else self.decision_sigma
        if len(ids) > MAX_DUAL_BAGS:
            held = VectorPairs(cells.sparkSession, self._train_vectors()[1])
            try:
                self.decision_sigma_ = given or held.median() or 1.0
                at = np.random.default_rng(self.seed).choice(len(ids), min(LANDMARKS, len(ids)), replace=False)
                self.result = solver.fit_products(lambda v: held.product(v, self.decision_sigma_), held.columns(at, self.decision_sigma_), at, y)
            finally:
                held.close()
            return self
        gram = collect_gram(self._gram(self.train, None), ids).values
        if self.spec.decision == "rbf":
            apart = gram[np.triu_indices(len(ids), 1)]
            apart = apart[apart > 0]
            self.decision_sigma_ = given or (float(np.median(apart)) if len(apart) else 1.0)
            gram = np.exp(-(gram**2) / (2 * self.decision_sigma_**2))
        self.result = solver.fit(gram, y)
        return self

    def _train_vectors(self) -> tuple[list, np.ndarray]:
        """Training bags in order, and their vectors."""
        held = self.train.toArrow().sort_by("bag_id")
        return held.column("bag_id").to_pylist(), k._matrix(held.column("embedding"))

    def predict(self, cells: DataFrame) -> DataFrame:
        """(bag_id, suitability) of every bag."""
        if self.result is None:
            raise ValueError("the model isn't fitted")
        rep = self._represent(self._scaled(cells))
        if self.spec.solver == "primal":
            return rep.select("bag_id", sigmoid(dot("embedding", literal_vector(self.result.coefficients))).alias("suitability"))
        if self.spec.decision == "rbf":
            eta = self._weighed_by_train(rep)
        else:
            alpha = cells.sparkSession.createDataFrame([(b, float(a)) for b, a in zip(self.bag_ids, self.result.coefficients, strict=True)], f"bag_j {dict(cells.dtypes)['bag_id']}, alpha double")
            eta = k.weighted_scores(self._gram(rep, self.train).join(F.broadcast(alpha), "bag_j")).withColumnRenamed("bag_i", "bag_id")  # MAX_DUAL_BAGS rows
        return eta.select("bag_id", sigmoid("eta").alias("suitability"))

    def classify(self, cells: DataFrame, threshold: float = 0.5) -> DataFrame:
        """(bag_id, suitability, predicted): 1 where the suitability is at or over the threshold."""
        return self.predict(cells).withColumn("predicted", (F.col("suitability") >= threshold).cast("int"))

    def _weighed_by_train(self, rep: DataFrame) -> DataFrame:
        """(bag_id, eta) of one vector a bag against all training vectors, which the driver and every task hold."""
        ids, vectors = self._train_vectors()
        order = {b: i for i, b in enumerate(ids)}
        alpha = np.array([a for _, a in sorted(zip((order[b] for b in self.bag_ids), self.result.coefficients, strict=True))])
        centre, sigma = vectors.mean(axis=0), self.decision_sigma_
        known = rep.sparkSession.sparkContext.broadcast((k.right_factor(vectors - centre), alpha))

        def score(batches):
            t, a = known.value
            for b in batches:
                if b.num_rows:
                    v = b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([b.column("bag_id"), pa.array(k.gaussian_sums(k.left_factor(v - centre), t, a, sigma))], ["bag_id", "eta"])

        return rep.mapInArrow(score, f"bag_id {dict(rep.dtypes)['bag_id']}, eta double")


def cross_validate(model: DistributionClassifier, cells: DataFrame, plan: DataFrame, n_splits: int) -> DataFrame:
    """(fold, bag_id, label, score) of every bag, scored by the model of the fold that leaves it out. plan has fold and bag_id."""
    out = None
    labels = cells.groupBy("bag_id").agg(F.max("label").alias("label"))
    for fold in range(n_splits):
        test = plan.filter(F.col("fold") == fold).select("bag_id")
        fitted = model.clone().fit(cells.join(test, "bag_id", "left_anti"))
        one = fitted.predict(cells.join(test, "bag_id", "left_semi")).select(F.lit(fold).alias("fold"), "bag_id", F.col("suitability").alias("score"))
        out = one if out is None else out.unionByName(one)
    return out.join(labels, "bag_id")


def permutation_importance(model: DistributionClassifier, cells: DataFrame, repeats: int = 3, seed: int = 0) -> DataFrame:
    """(feature, auc_drop): mean loss of AUC when a feature of the cells is replaced by values of random other cells."""
    from pyspark.sql import Window

    from terrabag.functions.expressions import hash_key, hash_uniform

    from .metrics import roc_auc

    labels = cells.groupBy("bag_id").agg(F.max("label").alias("label"))
    auc = lambda c: roc_auc(model.predict(c).join(labels, "bag_id").withColumnRenamed("suitability", "score")).first().auc
    base, rows = auc(cells), []
    numbered = cells.withColumn("__i", F.row_number().over(Window.partitionBy(F.floor(hash_uniform(seed, "cell_id") * 64)).orderBy(hash_key(seed, "bag_id", "cell_id"))))
    numbered = numbered.withColumn("__b", F.floor(hash_uniform(seed, "cell_id") * 64)).persist()
    sizes = F.broadcast(numbered.groupBy("__b").agg(F.max("__i").alias("__n")))  # 64 rows
    for f in range(model.width):
        drops = []
        for r in range(repeats):
            # Draws are from the cell's own random 64th of all cells, with replacement.
            asked = numbered.join(sizes, "__b").withColumn("__i", F.floor(hash_uniform(seed + 1 + r, F.lit(str(f)), "bag_id", "cell_id") * F.col("__n")) + 1)
            pool = numbered.select("__b", "__i", F.element_at("features", f + 1).alias("__v"))
            changed = asked.join(pool, ["__b", "__i"]).withColumn("features", F.transform("features", lambda v, i: F.when(i == f, F.col("__v")).otherwise(v)))
            drops.append(base - auc(changed.select(*cells.columns)))
        rows.append((f, float(np.mean(drops))))
    numbered.unpersist()
    return cells.sparkSession.createDataFrame(rows, "feature int, auc_drop double")
