"""Regularised logistic solvers: dual IRLS on a kernel matrix, primal Newton with distributed sums."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to as many bags the dual solver holds an N x N matrix on the driver; beyond, it needs products with the matrix only.
MAX_DUAL_BAGS = 5_000
#: Columns of the matrix that precondition such a solve, and its relative residual.
LANDMARKS, RESIDUAL = 256, 1e-7
#: Rows times features up to which the primal solver works on the driver.
LOCAL_NUMBERS = 4_000_000


@dataclass
class FitResult:
    """Coefficients with what the solver says about them."""

    coefficients: np.ndarray
    converged: bool
    iterations: int
    loss: float
    failure: str | None = None
    jitter: float = 0.0


def stable_sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


def solve_with_jitter(a: np.ndarray, b: np.ndarray, schedule: tuple[float, ...] = (0.0, 1e-8, 1e-6, 1e-4)) -> tuple[np.ndarray, float] | None:
    """(x, jitter) of the first relative jitter of the diagonal that gives a finite solution with a small residual."""
    scale = max(float(np.mean(np.abs(np.diag(a)))), 1.0)
    for j in schedule:
        try:
            x = np.linalg.solve(a + j * scale * np.eye(len(a)), b)
        except np.linalg.LinAlgError:
            continue
        if np.all(np.isfinite(x)) and np.linalg.norm(a @ x - b) <= 5e-3 * max(np.linalg.norm(b), 1e-12):
            return x, j * scale
    return None


@dataclass
class KernelLogistic:
    """Kernel logistic regression by iteratively reweighted least squares; the loss is the mean log-loss plus half lambda alpha K alpha."""

    lam: float = 0.1
    max_iter: int = 100
    tol: float = 0.01
    min_prob: float = 1e-7

    def fit(self, gram: np.ndarray, y: np.ndarray, start: np.ndarray | None = None) -> FitResult:
        n = len(y)
        if n > MAX_DUAL_BAGS:
            raise ValueError(f"{n} bags need a primal model; the dual one holds {MAX_DUAL_BAGS} at most")
        k, y = np.asarray(gram, float), np.asarray(y, float)
        alpha, jitter = (np.full(n, 1.0 / n) if start is None else np.array(start, float)), 0.0
        floor = max(self.min_prob, np.finfo(float).eps)

        def loss(a: np.ndarray) -> float:
            eta = k @ a
            return float(np.mean(np.logaddexp(0, eta) - y * eta) + 0.5 * self.lam * a @ eta)

        for it in range(1, self.max_iter + 1):
            eta = k @ alpha
            p = stable_sigmoid(eta)
            q = np.clip(p, floor, 1 - floor)
            w = q * (1 - q)
            z = eta + (y - p) / w
            if not (np.all(np.isfinite(z)) and np.all(np.isfinite(w))):
                return FitResult(alpha, False, it, float("nan"), "nonfinite_irls_state", jitter)
            got = solve_with_jitter(k + self.lam * np.diag(1 / w), z)
            if got is None:
                return FitResult(alpha, False, it, loss(alpha), "linear_solve_failed", jitter)
            new, jitter = got
            step, alpha = np.max(np.abs(new - alpha)), new
            if not np.isfinite(value := loss(alpha)):
                return FitResult(alpha, False, it, value, "nonfinite_loss", jitter)
            if step <= self.tol:
                return FitResult(alpha, True, it, value, None, jitter)
        return FitResult(alpha, False, self.max_iter, loss(alpha), "maximum_iterations", jitter)

    def fit_products(self, product, columns: np.ndarray, at: np.ndarray, y: np.ndarray) -> FitResult:
        """As fit(), for a positive matrix K that only product(v) = K v knows; `columns` are those of K at the places `at`.

        Each step's system is solved by conjugate gradients, preconditioned by the low-rank matrix that the columns span.
        """
        n, y = len(y), np.asarray(y, float)
        floor = max(self.min_prob, np.finfo(float).eps)
        half = np.linalg.cholesky(columns[at] + 1e-8 * len(at) * np.eye(len(at)))
        span = np.linalg.solve(half, columns.T).T
        alpha = np.full(n, 1.0 / n)
        eta = product(alpha)

        def loss() -> float:
            return float(np.mean(np.logaddexp(0, eta) - y * eta) + 0.5 * self.lam * alpha @ eta)

        for it in range(1, self.max_iter + 1):
            p = stable_sigmoid(eta)
            q = np.clip(p, floor, 1 - floor)
            w = q * (1 - q)
            z = eta + (y - p) / w
            if not (np.all(np.isfinite(z)) and np.all(np.isfinite(w))):
                return FitResult(alpha, False, it, float("nan"), "nonfinite_irls_state")
            s = np.sqrt(w)
            inner = self.lam * np.eye(span.shape[1]) + sum((span[i : i + 4096] * w[i : i + 4096, None]).T @ span[i : i + 4096] for i in range(0, n, 4096))
            eased = lambda r: (r - s * (span @ np.linalg.solve(inner, span.T @ (s * r)))) / self.lam  # noqa: B023, E731
            got = self._conjugate(lambda v: s * product(s * v) + self.lam * v, eased, s * z, alpha / s, (s * eta + self.lam * alpha / s))  # noqa: B023
            if got is None:
                return FitResult(alpha, False, it, loss(), "linear_solve_failed")
            new = s * got
            step, alpha = np.max(np.abs(new - alpha)), new
            eta = product(alpha)
            if not np.isfinite(value := loss()):
                return FitResult(alpha, False, it, value, "nonfinite_loss")
            if step <= self.tol:
                return FitResult(alpha, True, it, value)
        return FitResult(alpha, False, self.max_iter, loss(), "maximum_iterations")

    @staticmethod
    def _conjugate(apply, eased, b: np.ndarray, x: np.ndarray, applied: np.ndarray, most: int = 1000) -> np.ndarray | None:
        """Solution of apply(x) = b from a start whose product is `applied`; None if it doesn't come close."""
        r, limit = b - applied, RESIDUAL * max(np.linalg.norm(b), 1e-12)
        d = h = eased(r)
        rh = r @ h
        for _ in range(most):
            if np.linalg.norm(r) <= limit:
                return x
            moved = apply(d)
            a = rh / (d @ moved)
            x, r = x + a * d, r - a * moved
            h = eased(r)
            rh, old = r @ h, rh
            d = h + (rh / old) * d
        return x if np.linalg.norm(r) <= 5e-3 * max(np.linalg.norm(b), 1e-12) else None


@dataclass
class PrimalLogistic:
    """Logistic regression without intercept by Newton steps; the loss is the summed log-loss plus half lambda |beta|^2.

    Gradient and Hessian are sums over rows, made by partition and added up; the driver solves a system of the features' size.
    """

    lam: float = 0.1
    max_iter: int = 100
    tol: float = 1e-6

    def fit_arrays(self, x: np.ndarray, y: np.ndarray) -> FitResult:
        return self._newton(x.shape[1], lambda beta: self._sums(x, np.asarray(y, float), beta))

    def fit(self, rows: DataFrame, features: str = "features", label: str = "label") -> FitResult:
        """rows has one array of doubles and a label a row; it is kept while the steps run."""
        data = rows.select(features, F.col(label).cast("double").alias("y")).persist()
        try:
            size = data.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(features)).alias("d")).first()
            d = size.d or 0
            if 0 < size.n * d <= LOCAL_NUMBERS:
                held = data.toArrow()
                return self.fit_arrays(held.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(size.n, d), held.column(1).to_numpy())
            # Every partition sends a Hessian at each step, so they are no more than the cores, or than hold LOCAL_NUMBERS each.
            few = data.coalesce(max(data.sparkSession.sparkContext.defaultParallelism, -(-size.n * d // LOCAL_NUMBERS)))
            return self._newton(d, lambda beta: self._distributed(few, features, beta))
        finally:
            data.unpersist()

    @staticmethod
    def _sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        eta = x @ beta
        p = stable_sigmoid(eta)
        return x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x, float(np.sum(np.logaddexp(0, eta) - y * eta))

    def _distributed(self, data: DataFrame, features: str, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        d, sums = len(beta), self._sums

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(d + d * d + 1)
            for b in batches:
                if b.num_rows:
                    x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, d)
                    g, h, loss = sums(x, b.column(1).to_numpy(zero_copy_only=False), beta)
                    total += np.concatenate([g, h.ravel(), [loss]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

        got = data.mapInArrow(part, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # d + d^2 + 1 rows
        total = np.zeros(d + d * d + 1)
        for r in got:
            total[r.i] = r.v
        return total[:d], total[d:-1].reshape(d, d), float(total[-1])

    def _newton(self, d: int, sums) -> FitResult:
        beta, loss = np.zeros(d), float("nan")
        for it in range(1, self.max_iter + 1):
            g, h, loss = sums(beta)
            got = solve_with_jitter(h + self.lam * np.eye(d), g + self.lam * beta)
            loss += 0.5 * self.lam * float(beta @ beta)
            if got is None:
                return FitResult(beta, False, it, loss, "linear_solve_failed")
            beta = beta - got[0]
            if not np.all(np.isfinite(beta)):
                return FitResult(beta, False, it, loss, "nonfinite_state")
            if np.max(np.abs(got[0]), initial=0.0) <= self.tol:
                return FitResult(beta, True, it, loss, None, got[1])
        return FitResult(beta, False, self.max_iter, loss, "maximum_iterations")


@dataclass
class GramMatrix:
    """A collected Gram matrix and the bags of its rows."""

    bag_ids: list
    values: np.ndarray
    index: dict = field(default_factory=dict)


def collect_gram(upper: DataFrame, bag_ids: list) -> GramMatrix:
    """The symmetric matrix of an upper triangle in coordinate form; as large as the dual solver allows."""
    if len(bag_ids) > MAX_DUAL_BAGS:
        raise ValueError("too many bags for a dual model")
    index = {b: i for i, b in enumerate(bag_ids)}
    out, got = np.zeros((len(bag_ids), len(bag_ids))), upper.select("bag_i", "bag_j", "value").toArrow()
    known = pd.Index(bag_ids)
    i, j = (known.get_indexer(got.column(c).to_pandas()) for c in ("bag_i", "bag_j"))
    out[i, j] = out[j, i] = got.column("value").to_numpy()
    return GramMatrix(bag_ids, out, index)
