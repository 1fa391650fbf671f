"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The LDLᵀ factorisation of ``A - s I`` has as many positive pivots as A has eigenvalues above s
(Sylvester).  Bisection with these counts isolates eigenvalue number i in an interval of its own;
Rayleigh quotient iteration, which converges cubically, finishes it there; two more counts on both
sides of the result certify that it is number i.  Eigenvalues that double precision can't tell
apart are found together by block inverse iteration.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps
_ALPHA = (1 + 17 ** 0.5) / 8  # bounds the growth of the pivots
_STEPS = 60


def count_above(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of ``a`` above ``shift``: positive pivots of LDLᵀ with 1x1 and 2x2 blocks."""
    m = a - shift * np.eye(len(a))
    n, k, above = len(m), 0, 0

    def swap(i, j):
        if i != j:
            m[[i, j]] = m[[j, i]]
            m[:, [i, j]] = m[:, [j, i]]

    while k < n:
        below = np.abs(m[k + 1:, k])
        size = 1
        if len(below) and (big := below.max()) > 0:
            r = k + 1 + int(below.argmax())
            if abs(m[k, k]) < _ALPHA * big:
                row = np.abs(m[k:, r])
                row[r - k] = 0
                if abs(m[k, k]) * row.max() < _ALPHA * big * big:
                    if abs(m[r, r]) >= _ALPHA * row.max():
                        swap(k, r)
                    else:
                        swap(k + 1, r)
                        size = 2
        if size == 1:
            d = m[k, k]
            above += bool(d > 0)
            if d != 0:
                v = m[k + 1:, k].copy()
                m[k + 1:, k + 1:] -= np.outer(v, v / d)
        else:  # an indefinite block has one pivot of each sign
            above += 1
            b = m[k + 2:, k:k + 2].copy()
            m[k + 2:, k + 2:] -= b @ np.linalg.solve(m[k:k + 2, k:k + 2], b.T)
        k += size
    return above


def _solve(a: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """(a - shift I)^-1 b; the shift moves a little if it is an eigenvalue."""
    n, scale = len(a), max(float(np.abs(a).max()), 1e-300)
    for off in (0.0, 1.0, 16.0, 256.0):
        try:
            y = np.linalg.solve(a - (shift + off * _EPS * scale) * np.eye(n), b)
            if np.isfinite(y).all():
                return y
        except np.linalg.LinAlgError:
            pass
    raise ArithmeticError("no shift near the eigenvalue can be inverted")


def _without(x: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    for _ in range(2 if known else 0):
        k = np.array(known)
        x = x - k.T @ (k @ x)
    return x


def _rayleigh(a, low, high, known, seed, noise):
    """(eigenvalue, vector) by Rayleigh quotient iteration from inside an interval; None if it ends elsewhere."""
    x = _without(np.random.default_rng(seed).standard_normal(len(a)), known)
    x /= np.linalg.norm(x)
    shift, best = (low + high) / 2, None
    for step in range(_STEPS):
        x = _without(_solve(a, shift, x), known)
        x /= np.linalg.norm(x)
        value = float(x @ (a @ x))
        off = float(np.linalg.norm(a @ x - value * x))
        if best is None or off < best[0]:
            best = (off, value, x)
        elif best[0] <= noise:
            break
        if step > 0:  # the first steps stay at the middle, then the quotient takes over
            if not low <= value <= high:
                return None
            shift = value
    return best[1:] if best[0] <= noise and low <= best[1] <= high else None


def leading_pairs(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the ``most`` largest positive eigenvalues, falling.  Those
    that rounding can't tell from zero are left out."""
    a = np.asarray(a, float)
    n = len(a)
    top = float((np.abs(a).sum(axis=1)).max()) if n else 0.0
    if top == 0.0:
        return np.zeros(0), np.zeros((n, 0))
    noise = 8 * n * _EPS * top
    counts = {noise: count_above(a, noise), top * (1 + 4 * n * _EPS): 0}
    values, vectors = [], []
    wanted = min(most, counts[noise])
    while len(values) < wanted:
        i = len(values) + 1
        low = max(s for s, c in counts.items() if c >= i)
        high = min(s for s, c in counts.items() if c < i)
        width, alone = counts[low] - counts[high], counts[low] == i and counts[high] == i - 1
        if high - low <= 4 * noise and not alone:
            cluster = _cluster(a, low, width, vectors)
            values += [v for v, _ in cluster]
            vectors += [x for _, x in cluster]
            continue
        if alone and (found := _rayleigh(a, low, high, vectors, i, noise)):
            value, x = found
            sure = count_above(a, value - 2 * noise) >= i and count_above(a, value + 2 * noise) <= i - 1
            if sure or high - low <= 4 * noise:
                values.append(value)
                vectors.append(x)
                continue
        middle = (low + high) / 2
        if not low < middle < high:
            raise ArithmeticError(f"eigenvalue {i} can't be isolated")
        counts[middle] = count_above(a, middle)
    return np.array(values[:wanted]), np.array(vectors[:wanted]).T.reshape(n, -1)


def _cluster(a, shift, size, known):
    """Pairs of ``size`` eigenvalues that lie together just above ``shift``."""
    x = np.random.default_rng(size).standard_normal((len(a), size))
    for _ in range(8):
        x = _solve(a, shift, x)
        x = np.linalg.qr(np.column_stack([_without(c, known) for c in (x / np.linalg.norm(x, axis=0)).T]))[0]
    # their values differ by rounding only, so any orthonormal basis of the block is one of eigenvectors
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return [(float(values[j]), x[:, j]) for j in order]
