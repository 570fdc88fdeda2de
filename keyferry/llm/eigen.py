"""Leading eigenpairs of a symmetric matrix: Householder, Sturm counts, inverse iteration."""

import numpy as np


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and Householder vectors (columns) of an orthogonally similar tridiagonal matrix."""
    a = np.array(matrix, dtype=np.float64)
    n = len(a)
    vectors = np.zeros((n, max(n - 2, 0)))
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        length = np.linalg.norm(x)
        if length == 0:
            continue
        x[0] += length if x[0] >= 0 else -length
        x /= np.linalg.norm(x)
        vectors[k + 1 :, k] = x
        rest = a[k + 1 :, k + 1 :]
        p = rest @ x
        w = 2 * p - 2 * (x @ p) * x
        rest -= np.outer(x, w) + np.outer(w, x)
        kept = a[k + 1 :, k] - 2 * x * (x @ a[k + 1 :, k])
        a[k + 1 :, k] = a[k, k + 1 :] = kept
    return np.diag(a).copy(), np.diag(a, -1).copy(), vectors


def count_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of some values: the negative pivots of the shifted matrix."""
    tiny = np.finfo(np.float64).tiny ** 0.5
    pivot = diagonal[0] - at
    found = (pivot < 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = d - at - e * e / pivot
        found += pivot < 0
    return found


def leading_values(diagonal: np.ndarray, off: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` largest eigenvalues, falling, by bisection until neighbouring doubles are reached."""
    n = len(diagonal)
    beside = np.abs(np.append(off, 0.0)) + np.abs(np.append(0.0, off))
    # the number of eigenvalues below the i-th largest, counted from 0
    below = n - 1 - np.arange(min(most, n))
    low = np.full(len(below), (diagonal - beside).min())
    high = np.full(len(below), (diagonal + beside).max())
    while True:
        middle = (low + high) / 2
        if np.all((middle <= low) | (middle >= high)):
            return high
        right = count_below(diagonal, off, middle) <= below
        low, high = np.where(right, middle, low), np.where(right, high, middle)


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """Solve (T - shift) x = right by elimination with row exchanges; a pivot is never under ``least``."""
    n = len(diagonal)
    d = diagonal - shift
    upper, second, lower = np.append(off, 0.0), np.zeros(n), off.copy()
    x = right.copy()
    for i in range(n - 1):
        if abs(lower[i]) > abs(d[i]):
            d[i], lower[i] = lower[i], d[i]
            upper[i], d[i + 1] = d[i + 1], upper[i]
            if i + 1 < n - 1:
                second[i], upper[i + 1] = upper[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(d[i]) < least:
            d[i] = least
        f = lower[i] / d[i]
        d[i + 1] -= f * upper[i]
        if i + 1 < n - 1:
            upper[i + 1] -= f * second[i]
        x[i + 1] -= f * x[i]
    if abs(d[-1]) < least:
        d[-1] = least
    for i in range(n - 1, -1, -1):
        for j, c in ((i + 1, upper[i]), (i + 2, second[i])):
            if j < n:
                x[i] -= c * x[j]
        x[i] /= d[i]
    return x


def _vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) by inverse iteration; those of close values are made orthogonal to each other."""
    n = len(diagonal)
    size = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(np.float64).tiny)
    close, least = 1e-3 * size, np.finfo(np.float64).eps * size
    rng = np.random.default_rng(1)
    found = np.zeros((n, len(values)))
    cluster, shift = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > close:
            cluster = j
        # equal values are moved apart a little, or the same vector would come out
        shift = value if j == cluster else min(value, shift - 8 * least)
        x = rng.standard_normal(n)
        for _ in range(6):
            x = _solve(diagonal, off, shift, x / np.linalg.norm(x), least)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= found[:, cluster:j] @ (found[:, cluster:j].T @ x)
        found[:, j] = x / np.linalg.norm(x)
    return found


def leading_pairs(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    if not len(matrix):
        return np.zeros(0), np.zeros((0, 0))
    scale = np.abs(matrix).max()
    if scale == 0:
        return np.zeros(min(most, len(matrix))), np.eye(len(matrix))[:, :most]
    diagonal, off, reflectors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, most)
    vectors = _vectors(diagonal, off, values)
    for k in range(reflectors.shape[1] - 1, -1, -1):
        v = reflectors[:, k]
        vectors -= 2 * np.outer(v, v @ vectors)
    return values * scale, vectors
