"""Singular values and right singular vectors of a small triangular matrix by quotient-difference steps.

Householder reflections make the matrix bidiagonal, dqds finds its squared singular values, and
twisted factorisations give a vector for each. All of this is for a matrix whose side is the number
of dimensions; rows of data never come here.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
CLOSE = 1e-3  # relative gap under which vectors are made orthogonal to each other


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) with r = U B V^T, B upper bidiagonal."""
    n = r.shape[1]
    a = np.zeros((max(n, len(r)), n))
    a[: len(r)] = r
    v = np.eye(n)
    for k in range(n):
        h, beta = _reflector(a[k:, k])
        if beta:
            a[k:, k:] -= beta * np.outer(h, h @ a[k:, k:])
        if k < n - 2:
            h, beta = _reflector(a[k, k + 1 :])
            if beta:
                a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ h, h)
                v[:, k + 1 :] -= beta * np.outer(v[:, k + 1 :] @ h, h)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(h, beta) with (I - beta h h^T) x a multiple of the first unit vector."""
    size = np.abs(x).max(initial=0.0)
    if not size or len(x) < 2:
        return x, 0.0
    h = x / size
    h[0] += np.copysign(np.linalg.norm(h), h[0])
    return h, 2.0 / float(h @ h)


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues, ascending, of B^T B for a bidiagonal B with squares q (diagonal) and e (superdiagonal).

    Shifts are rigorous lower bounds: 1 / trace((B B^T)^-1), which a step without a shift yields, or
    Gershgorin's. A step that turns out negative for rounding is left out.
    """
    found: list[float] = []
    work = [(np.array(q, float), np.array(e, float), 0.0)]
    while work:
        q, e, sigma = work.pop()
        for _ in range(100 * len(q) + 100):
            n = len(q)
            if n == 1:
                found.append(q[0] + sigma)
                break
            free = _negligible(q, e, sigma)
            if free[-1]:
                found.append(q[-1] + sigma)
                q, e = q[:-1], e[:-1]
                continue
            if free.any():
                k = int(np.flatnonzero(free)[-1])
                work.append((q[: k + 1], e[:k], sigma))
                q, e = q[k + 1 :], e[k + 1 :]
                continue
            if q[0] < q[-1] / 2:  # smallest last: the other way round has the same values
                q, e = q[::-1].copy(), e[::-1].copy()
            q, e, d = _step(q, e, 0.0)
            if d.min() > 0:
                side = np.sqrt(q[1:] * e)
                gershgorin = (q - np.append(side - e, 0.0) - np.append(0.0, side)).min()
                shift = max(1 / float((1 / d).sum()), gershgorin) * (1 - 8 * n * EPS)
                new_q, new_e, d = _step(q, e, shift)
                if (d >= 0).all():
                    q, e, sigma = new_q, new_e, sigma + shift
        else:
            raise ArithmeticError("dqds did not converge")
    return np.sort(np.array(found))


def _negligible(q: np.ndarray, e: np.ndarray, sigma: float) -> np.ndarray:
    """Where the superdiagonal changes no eigenvalue, shift included, by more than rounding."""
    alone = e <= (16 * EPS) ** 2 * (sigma + np.minimum(q[:-1], q[1:])) + 1e-300
    return alone | ((e * np.maximum(q[:-1], q[1:]) <= (EPS * sigma / 4) ** 2) & (e <= EPS * sigma / 4))


def _step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One qd step with a shift: new squares, and the d's that stand before each division."""
    n = len(q)
    new_q, new_e, ds = np.empty(n), np.empty(n - 1), np.empty(n)
    d = q[0] - shift
    for k in range(n - 1):
        ds[k] = d
        new_q[k] = d + e[k]
        if new_q[k] == 0:
            return np.maximum(q, 0), e, np.full(n, -1.0)
        t = q[k + 1] / new_q[k]
        new_e[k] = e[k] * t
        d = d * t - shift
    ds[-1] = new_q[-1] = d
    return new_q, new_e, ds


class Twisted:
    """B^T B - lam = L+ D+ L+^T (from the top) and U- D- U-^T (from the bottom), joined at any twist."""

    def __init__(self, a: np.ndarray, b: np.ndarray, lam: float):
        n = len(a)
        pivot = EPS * EPS * float((a * a).max()) + 1e-300
        d, ld, lld = a * a, a[:-1] * b, b * b  # ld: offdiagonal of B^T B
        self.down, self.up = np.empty(n - 1), np.empty(n - 1)
        self.dplus, self.dminus = np.empty(n), np.empty(n)
        s = np.empty(n)
        s[0] = -lam
        for k in range(n - 1):
            x = _away(s[k] + d[k], pivot)
            self.dplus[k] = x
            self.down[k] = ld[k] / x
            s[k + 1] = (self.down[k] * (b[k] / a[k]) * s[k] if a[k] else lld[k]) - lam
        self.dplus[-1] = _away(s[-1] + d[-1], pivot)
        p = np.empty(n)
        p[-1] = d[-1] - lam
        for k in range(n - 2, -1, -1):
            x = _away(lld[k] + p[k + 1], pivot)
            self.dminus[k + 1] = x
            self.up[k] = ld[k] / x
            p[k] = p[k + 1] * (d[k] / x) - lam
        self.dminus[0] = _away(p[0], pivot)
        self.gamma = s + p + lam

    def vector(self) -> np.ndarray:
        """The null vector of the factorisation twisted where its pivot is least."""
        k = int(np.argmin(np.abs(self.gamma)))
        z = np.zeros(len(self.gamma))
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -self.down[i] * z[i + 1]
        for i in range(k, len(z) - 1):
            z[i + 1] = -self.up[i] * z[i]
        return z

    def solve(self, x: np.ndarray) -> np.ndarray:
        """(B^T B - lam)^-1 x by the factorisation from the top."""
        y = np.array(x, float)
        n = len(y)
        for i in range(n - 1):
            y[i + 1] -= self.down[i] * y[i]
        y /= self.dplus
        for i in range(n - 2, -1, -1):
            y[i] -= self.down[i] * y[i + 1]
        return y


def _away(x: float, pivot: float) -> float:
    return x if abs(x) > pivot else (-pivot if x < 0 else pivot)


def vectors(a: np.ndarray, b: np.ndarray, lams: np.ndarray, wanted: int) -> np.ndarray:
    """Unit eigenvectors (columns) of B^T B for the `wanted` largest of one unreduced block's eigenvalues.

    Each comes from its own twisted factorisation, and those of close eigenvalues are made orthogonal
    to each other. Eigenvalues that agree to rounding have no vectors of their own: any basis of their
    space will do, and inverse iteration with as many vectors as there are ties finds one.
    """
    n, r = len(a), np.random.default_rng(0)
    lam = np.sort(lams)[::-1][:wanted]
    out = np.empty((n, len(lam)))
    nothing = 64 * n * EPS * float(lams.max())
    first, j = 0, 0
    while j < len(lam):
        if j and lam[j - 1] - lam[j] > CLOSE * lam[j - 1] and lam[j - 1] > nothing:
            first = j
        k = j + 1
        while k < len(lam) and lam[k - 1] - lam[k] <= nothing:
            k += 1
        near, t = out[:, first:j], Twisted(a, b, float(lam[j]))
        if k == j + 1:
            z = t.vector()[:, None]
            out[:, j:k] = _apart(z, near)
        else:
            z = _apart(r.standard_normal((n, k - j)), near)
            for _ in range(4):
                z = _apart(np.array([t.solve(x) for x in z.T]).T, near)
            out[:, j:k] = z
        j = k
    return out


def _apart(z: np.ndarray, near: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns, without what lies in `near`."""
    z = z / np.abs(z).max(0)
    for _ in range(2):
        z = np.linalg.qr(z - near @ (near.T @ z))[0]
    return z


def right_singular(r: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, falling, of all dimensions; unit right singular vectors of the `wanted` largest)."""
    n = r.shape[1]
    scale = float(np.abs(r).max(initial=0.0))
    if not scale:
        return np.zeros(n), np.eye(n)[:, :wanted]
    a, b, v = bidiagonal(r / scale)
    b = np.where(np.abs(b) <= EPS * (np.abs(a[:-1]) + np.abs(a[1:])) * 0.5, 0.0, b)
    cuts = np.concatenate([[0], np.flatnonzero(b == 0) + 1, [n]])
    blocks = [(int(lo), int(hi), dqds(a[lo:hi] ** 2, b[lo : hi - 1] ** 2)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    every = np.sort(np.concatenate([lam for _, _, lam in blocks]))[::-1]
    lams, columns = [], []
    for lo, hi, lam in blocks:
        w = vectors(a[lo:hi], b[lo : hi - 1], lam, min(wanted, hi - lo))
        for k, x in enumerate(np.sort(lam)[::-1][: w.shape[1]]):
            z = np.zeros(n)
            z[lo:hi] = w[:, k]
            lams.append(x)
            columns.append(z)
    top = np.argsort(-np.array(lams), kind="stable")[:wanted]
    out = v @ np.array([columns[k] for k in top]).T
    out = np.linalg.qr(out)[0]  # what rounding left between blocks and far eigenvalues
    return np.maximum(every, 0) * scale * scale, out
