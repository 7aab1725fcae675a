"""Least-squares minimisers over a state on the driver, and what is derived from them.

A problem is a cost function of independent variables with its gradient; each
evaluation may run Spark jobs for H and its transpose.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Gradient = Callable[[np.ndarray], np.ndarray]


@dataclass
class Solution:
    x: np.ndarray
    iterations: int
    converged: bool
    norms: list[float] = field(default_factory=list)
    eigenvalues: np.ndarray = field(default_factory=lambda: np.zeros(0))
    eigenvectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


def lanczos(gradient: Gradient, x0: np.ndarray, iterations: int = 100, reduction: float = 1e8) -> Solution:
    """The minimum of a quadratic cost and leading eigenpairs of its Hessian, by Lanczos vectors that are orthogonalised anew each step.

    The Hessian's product with a vector is the difference of two gradients. It ends when the
    gradient's norm has fallen by `reduction`, or after so many iterations.
    """
    g0 = gradient(x0)
    first = float(np.linalg.norm(g0))
    if first == 0:
        return Solution(x0, 0, True, [0.0])
    basis, alpha, beta, norms = [-g0 / first], [], [], [first]
    converged = False
    for k in range(min(iterations, len(x0))):
        q = basis[k]
        w = gradient(x0 + q) - g0
        alpha.append(float(q @ w))
        w = w - alpha[k] * q - (beta[k - 1] * basis[k - 1] if k else 0)
        for _ in range(2):
            for v in basis:
                w = w - (v @ w) * v
        beta.append(float(np.linalg.norm(w)))
        y = np.linalg.solve(tridiagonal(alpha, beta), first * np.eye(len(alpha))[0])
        norms.append(beta[k] * abs(float(y[-1])))
        if norms[-1] <= first / reduction or beta[k] <= 1e-12 * abs(alpha[0]):
            converged = True
            break
        basis.append(w / beta[k])
    q = np.array(basis[: len(alpha)]).T
    t = tridiagonal(alpha, beta)
    y = np.linalg.solve(t, first * np.eye(len(alpha))[0])
    values, vectors = np.linalg.eigh(t)
    order = np.argsort(-values)
    return Solution(x0 + q @ y, len(alpha), converged, norms, values[order], (q @ vectors[:, order]))


def tridiagonal(alpha: list[float], beta: list[float]) -> np.ndarray:
    n = len(alpha)
    return np.diag(alpha) + np.diag(beta[: n - 1], 1) + np.diag(beta[: n - 1], -1)


def conjugate_gradient(cost: Callable[[np.ndarray], float], gradient: Gradient, x0: np.ndarray, iterations: int = 100, reduction: float = 1e6) -> Solution:
    """Polak-Ribiere directions with a step by the secant of two gradients, halved while the cost rises."""
    x, g, value = x0, gradient(x0), cost(x0)
    first = float(np.linalg.norm(g))
    norms, d = [first], -g
    for k in range(iterations):
        if norms[-1] <= first / reduction:
            return Solution(x, k, True, norms)
        slope = float(g @ d)
        if slope >= 0:
            d, slope = -g, -float(g @ g)
        bend = float((gradient(x + d) - g) @ d)
        step = -slope / bend if bend > 0 else 1.0
        while (after := cost(x + step * d)) > value and step > 1e-14:
            step /= 2
        x = x + step * d
        new, value = gradient(x), after
        d = -new + max(0.0, float(new @ (new - g)) / max(float(g @ g), 1e-300)) * d
        g = new
        norms.append(float(np.linalg.norm(g)))
    return Solution(x, iterations, norms[-1] <= first / reduction, norms)


class Recent:
    """The last result by argument and step, so that a cost and a gradient at one point share a forward run."""

    def __init__(self, run: Callable[[np.ndarray, str], object]):
        self.run, self.key, self.value = run, None, None

    def __call__(self, x: np.ndarray, step: str = "var4d") -> object:
        key = step, x.tobytes()
        if key != self.key:
            self.key, self.value = key, self.run(x, step)
        return self.value


def gradient_test(cost: Callable[[np.ndarray], float], gradient: Gradient, x: np.ndarray, powers: range = range(3, 10)) -> list[tuple[float, float]]:
    """Step lengths, and how the cost's change compares with what the gradient says: near 1 where steps are small but not too small."""
    g = gradient(x)
    direction = -g / np.linalg.norm(g)
    return [(a, (cost(x + a * direction) - cost(x)) / (a * float(g @ direction))) for a in (10.0**-p for p in powers)]


def posterior_sigma(sigma: np.ndarray, root: Callable[[np.ndarray], np.ndarray], solution: Solution) -> np.ndarray:
    """Posterior errors: each eigenvector, brought to the state's space, lowers them by 1 / eigenvalue - 1."""
    variance = sigma**2
    for value, vector in zip(solution.eigenvalues, solution.eigenvectors.T, strict=True):
        variance = variance + root(vector) ** 2 * (1 / value - 1)
    return np.sqrt(np.maximum(variance, 0))


def observation_cost(departures: DataFrame) -> DataFrame:
    """One row: half the sum of squares of mismatch / sigma, and how many there are."""
    return departures.agg((F.sum(F.try_divide(F.col("mismatch"), F.col("sigma")) * F.try_divide(F.col("mismatch"), F.col("sigma"))) / 2).alias("j_obs"), F.count("*").alias("n_obs"))


def state_cost(state: DataFrame, value: str = "state") -> DataFrame:
    return state.agg((F.sum(F.col(value) * F.col(value)) / 2).alias("j_bg"))


def norm(rows: DataFrame, value: str) -> DataFrame:
    return rows.agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"))


def reduced_chi2(cost: DataFrame, iterations: int) -> DataFrame:
    """Twice the cost over observations less iterations."""
    return cost.select((F.col("j_obs") * 2 / (F.col("n_obs") - iterations)).alias("chi2"), "n_obs")
