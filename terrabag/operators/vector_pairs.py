"""All pairs of many vectors without a matrix of them: products with their Gaussian kernel, and their median distance.

Every task holds all vectors and makes the rows of the matrix that it is asked for, a few at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as k

#: Bins of a pass over distances, distances that the driver sorts, and pairs that tell it where the median may be.
BINS, SORTED, SAMPLE = 2**15, 1_000_000, 2**18
#: Added to bounds of distances, so that their squares aren't 0.
TINY = 1e-150


class VectorPairs:
    """Pairs among the rows of a matrix, which is broadcast."""

    def __init__(self, spark: SparkSession, vectors: np.ndarray):
        # Distances are sums that cancel least around the middle.
        self.spark, self.vectors = spark, vectors - vectors.mean(axis=0)
        self.shared = spark.sparkContext.broadcast(k.right_factor(self.vectors))

    def close(self) -> None:
        self.shared.destroy()

    def _rows(self, work: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str, deal: int = 4) -> DataFrame:
        """work(places, left, right) of all places, some in each of `deal` tasks a core, with the factors of their half squares."""
        shared = self.shared

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b.column(0).to_numpy()
                # Factors have the same rows but for the order of the last two.
                left = shared.value[:, at].T
                yield from work(at, np.concatenate([left[:, :-2], left[:, :-3:-1]], axis=1), shared.value)

        n = len(self.vectors)
        parts = min(n, deal * self.spark.sparkContext.defaultParallelism)
        # Places go around, as later ones have fewer pairs in the upper triangle.
        dealt = self.spark.range(parts, numPartitions=parts).select(F.explode(F.sequence("id", F.lit(n - 1), F.lit(parts))).alias("id"))
        return dealt.mapInArrow(each, schema)

    def columns(self, at: np.ndarray, sigma: float) -> np.ndarray:
        return k.GaussianKernel(sigma)(self.vectors, self.vectors[at])

    def product(self, v: np.ndarray, sigma: float) -> np.ndarray:
        """The kernel's matrix times v."""
        v = np.ascontiguousarray(v)

        def work(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(k.gaussian_sums(left, right, v, sigma))], ["i", "v"])

        got, out = self._rows(work, "i long, v double").toArrow(), np.empty(len(v))
        out[got.column("i").to_numpy()] = got.column("v").to_numpy()
        return out

    def _bracket(self) -> tuple[float, float]:
        """Bounds that the median of the positive distances is most likely between, by a sample of pairs."""
        rng, d = np.random.default_rng(0), []
        for _ in range(0, SAMPLE, 2**14):
            i, j = rng.integers(0, len(self.vectors), (2, 2**14))
            apart = self.vectors[i] - self.vectors[j]
            d.append(np.sqrt((apart * apart).sum(axis=1)))
        d = np.concatenate(d)
        low, high = np.quantile(d[d > 0], [0.495, 0.505]) if (d > 0).any() else (0.0, 0.0)
        return float(low), float(high) * (1 + 1e-9) + TINY

    def median(self) -> float | None:
        """Median of the positive distances, exactly; None if there is none. Each pass counts them in finer bins around the middle."""

        def apart(at: np.ndarray, left: np.ndarray, right: np.ndarray, low: float, high: float) -> Iterator[tuple[int, int, np.ndarray]]:
            """Positive distances under low and at high or over it, and the others, block by block of the upper triangle."""
            for i in range(0, len(at), k.BLOCK[0]):
                own = at[i : i + k.BLOCK[0]]
                for _, j, b in k.half_squares(left[i : i + len(own)], right[:, own[0] :]):
                    b *= -2.0
                    if own[0] + j <= own[-1]:
                        b[np.arange(own[0] + j, own[0] + j + b.shape[1])[None, :] <= own[:, None]] = 0.0
                    less, more = b < low * low, b >= high * high
                    d = b[~(less | more)]
                    yield int(np.count_nonzero(less) - np.count_nonzero(b <= 0.0)) if low * low > 0.0 else 0, int(np.count_nonzero(more)), np.sqrt(d[d > 0.0])

        def counted(low: float, high: float) -> np.ndarray:
            """Distances by bin of [low, high); those under it, and the others."""

            def work(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
                n = np.zeros(BINS + 2, np.int64)
                for under, over, d in apart(at, left, right, low, high):
                    place = np.clip(np.floor((d - low) * (BINS / (high - low))), 0, BINS - 1).astype(np.int64) + 1
                    if len(d) < BINS:
                        np.add.at(n, place, 1)
                    else:
                        n += np.bincount(place, minlength=BINS + 2)
                    n[0], n[-1] = n[0] + under, n[-1] + over
                here = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(n[here])], ["b", "n"])

            out = np.zeros(BINS + 2, np.int64)
            for r in self._rows(work, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():  # BINS + 2 rows
                out[r.b] = r.n
            return out

        most = 2.0 * float(np.sqrt((self.vectors * self.vectors).sum(axis=1).max())) * (1 + 1e-6) + TINY
        (low, high), guessed = self._bracket(), True
        while True:
            n = counted(low, high)
            total, run = int(n.sum()), np.cumsum(n)
            if not total:
                return None
            ranks = (total - 1) // 2, total // 2
            first, last = (int(np.searchsorted(run, r, "right")) for r in ranks)
            width = (high - low) / BINS
            if guessed and (first == 0 or last == BINS + 1):  # from all distances down
                low, high, guessed = 0.0, most, False
                continue
            guessed = False
            # A bin of slack on both sides, as a bound's rounding may move a distance by one.
            low, high = max(0.0, low + (first - 2) * width), low + (last + 1) * width
            if n[max(first - 1, 0) : last + 2].sum() <= SORTED or width <= 1e-14 * high:
                break

        def work(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
            under, _, d = zip(*apart(at, left, right, low, high), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([sum(under)]), pa.array([np.concatenate(d)], pa.list_(pa.float64()))], ["under", "d"])

        if width <= 1e-14 * high:
            return (low + high) / 2
        got = self._rows(work, "under long, d array<double>").toArrow()
        under = sum(got.column("under").to_pylist())
        held = np.sort(got.column("d").combine_chunks().flatten().to_numpy(zero_copy_only=False))
        return float((held[ranks[0] - under] + held[ranks[1] - under]) / 2)
