"""The largest eigenvalues of a symmetric matrix, by contour integration.

The resolvent of a matrix, integrated around an interval of the real line, is the projection onto the eigenvectors
whose eigenvalues lie in it.  Gauss-Legendre nodes on a half circle turn the integral into a few solves with complex
shifts; applied to a random block they give a subspace, Rayleigh-Ritz takes eigenpairs out of it, and repeating
that with the new block refines it.  How many eigenvalues an interval holds is known beforehand: by Sylvester's law as many
as the factors L D L' of the matrix, shifted by its ends, differ in positive pivots.
"""

from __future__ import annotations

import numpy as np

NODES = 8
#: eigenvalues of an interval, unless they are too close to be told apart
FEW = 8
SWEEPS = 30


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are greater than ``shift``: positive pivots of L D L' with the largest pivot, of one row or two."""
    a = matrix - shift * np.eye(len(matrix))
    count, limit = 0, (1 + 17**0.5) / 8
    while len(a):
        size = np.abs(a)
        i = int(size.diagonal().argmax())
        off = size - np.diag(size.diagonal())
        r, s = divmod(int(off.argmax()), len(a))
        if size[i, i] == 0 and off[r, s] == 0:
            return count
        if size[i, i] >= limit * off[r, s]:
            pivot, take = a[i, i], [i]
            count += pivot > 0
            rest = np.delete(np.arange(len(a)), take)
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, i], a[i, rest]) / pivot
        else:  # a pivot of two rows has one eigenvalue of either sign
            take = sorted((r, s))
            count += 1
            rest = np.delete(np.arange(len(a)), take)
            b = a[np.ix_(rest, take)]
            a = a[np.ix_(rest, rest)] - b @ np.linalg.solve(a[np.ix_(take, take)], b.T)
        a = (a + a.T) / 2
    return count


def intervals(matrix: np.ndarray, wanted: int, low: float, high: float) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside), from the highest down, that together hold the ``wanted`` largest above ``low``."""
    out, held = [], 0
    todo = [(low, high, above(matrix, low), above(matrix, high))]
    narrow = 64 * np.finfo(float).eps * high
    while todo and held < wanted:
        a, b, at_a, at_b = todo.pop()
        n = at_a - at_b
        if n == 0:
            continue
        if n <= FEW or b - a <= narrow:
            out.append((a, b, n))
            held += n
            continue
        middle = (a + b) / 2
        at_middle = above(matrix, middle)
        todo += [(a, middle, at_a, at_middle), (middle, b, at_middle, at_b)]
    return out


def contour(matrix: np.ndarray, low: float, high: float, n: int) -> tuple[float, float, int]:
    """(low, high, eigenvalues inside) of a circle around the n eigenvalues of an interval, with room on either side but
    few others inside, so that none far outside is near to it."""
    at_low, at_high = above(matrix, low), above(matrix, high)
    a, b, p, q = low, high, high, low  # the least eigenvalue lies in (a, p], the greatest in (q, b]
    for _ in range(60):
        if p - a <= (b - a) / 16 and b - q <= (b - a) / 16 or b - a <= 1e-14 * abs(high):
            break
        middle = (a + p) / 2
        a, p = (middle, p) if above(matrix, middle) == at_low else (a, middle)
        middle = (q + b) / 2
        q, b = (q, middle) if above(matrix, middle) == at_high else (middle, b)
    room = (high - low) / 2
    while True:
        inside = above(matrix, a - room) - above(matrix, b + room)
        if inside <= n + 4 or room <= 1e-14 * abs(high):
            return a - room, b + room, inside
        room /= 2


def within(matrix: np.ndarray, low: float, high: float, n: int, rng: np.random.Generator) -> np.ndarray | None:
    """The n eigenvectors of an interval, or None if as many are not found."""
    left, right, inside = contour(matrix, low, high, n)
    d = len(matrix)
    size = min(d, 2 * inside + 4)
    block = rng.standard_normal((d, size))
    x, weights = np.polynomial.legendre.leggauss(NODES)
    angle = -np.pi / 2 * (x - 1)
    centre, radius = (left + right) / 2, max((right - left) / 2, 1e-13 * abs(high))
    scale = np.abs(matrix).sum(axis=1).max()
    for _ in range(SWEEPS):
        total = np.zeros((d, size))
        for t, w in zip(angle, weights):
            z = radius * np.exp(1j * t)
            total += w / 2 * (z * np.linalg.solve((centre + z) * np.eye(d) - matrix, block)).real
        basis = np.linalg.qr(total)[0]
        values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
        block = basis @ turn
        own = (values > low) & (values <= high)
        error = np.linalg.norm(matrix @ block - block * values, axis=0)
        if own.sum() == n and error[own].max() <= 4 * d * np.finfo(float).eps * scale:
            return block[:, own]
    return None


def largest(matrix: np.ndarray, wanted: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the ``wanted`` largest eigenvalues of a positive semidefinite matrix, falling; only
    those above rounding.  If an interval's count is not met, its ends are at fault (they are too near to an eigenvalue)
    and all intervals are laid anew."""
    d = len(matrix)
    high = float(np.abs(matrix).sum(axis=1).max()) if d else 0.0
    if high <= 0 or wanted <= 0:
        return np.zeros(0), np.zeros((d, 0))
    rng = np.random.default_rng(seed)
    for attempt in range(20):
        low = d * np.finfo(float).eps * high * (1 + 0.37 * attempt)
        parts = intervals(matrix, wanted, low, high * (1.01 + 0.0173 * attempt))
        found = [within(matrix, a, b, n, rng) for a, b, n in parts]
        if all(f is not None for f in found):
            break
    else:
        raise ArithmeticError("eigenvalues found and counted by inertia differ")
    if not found:
        return np.zeros(0), np.zeros((d, 0))
    basis = np.linalg.qr(np.concatenate(found, axis=1))[0]
    values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], (basis @ turn)[:, order]
