"""Sparse inverse covariance (the graphical lasso of Friedman, Hastie & Tibshirani 2008), and the joint two-group model whose
penalty couples the groups (Guo, Levina, Michailidis & Zhu 2011)."""

from __future__ import annotations

import warnings

import numpy as np

#: Entries of a precision matrix below this, after scaling to a unit diagonal, are noise.
NOISE = 1e-5
#: Sums of magnitudes are kept at this at least before they are inverted.
FLOOR = 1e-10


def soft(x, t):
    return np.sign(x) * np.maximum(np.abs(x) - t, 0.0)


def _log_det(theta: np.ndarray) -> float:
    """Log determinant, or -inf where the matrix is not positive definite."""
    try:
        return 2.0 * float(np.log(np.diag(np.linalg.cholesky(theta))).sum())
    except np.linalg.LinAlgError:
        return -np.inf


def glasso(S: np.ndarray, rho: np.ndarray | float, penalize_diagonal: bool = True, max_iter: int = 2000, tol: float = 1e-4, zero: np.ndarray | None = None, start: np.ndarray | None = None) -> np.ndarray:
    """The minimiser of -log det T + tr(S T) + sum rho |T|. zero: boolean matrix of entries that must vanish.

    Proximal gradient steps with Barzilai-Borwein lengths and backtracking (after Rolfs et al. 2012): all work is dense
    linear algebra. Stops when the optimality conditions hold to 10 * tol times the mean off-diagonal of S. start: a
    positive definite matrix to begin with.
    """
    p = len(S)
    rho = np.broadcast_to(np.asarray(rho, float), (p, p)).copy()
    if not penalize_diagonal:
        np.fill_diagonal(rho, 0.0)
    if zero is not None:
        rho[zero] = 1e12
    off = ~np.eye(p, dtype=bool)
    if p == 1:
        return 1.0 / (S + rho)
    if not rho.any():
        return np.linalg.inv(S)
    goal = 10 * tol * max(float(np.abs(S[off]).mean()), 1e-12)
    theta = np.diag(1.0 / np.maximum(np.diag(S) + np.diag(rho), FLOOR)) if start is None else start.copy()
    if zero is not None:
        theta[zero] = 0.0
    log_det = _log_det(theta)
    if not np.isfinite(log_det):
        theta = np.diag(1.0 / np.maximum(np.diag(S) + np.diag(rho), FLOOR))
        log_det = _log_det(theta)
    W = np.linalg.inv(theta)
    smooth = -log_det + float((S * theta).sum())
    step = 1.0 / max(float(np.linalg.eigvalsh(W)[-1]) ** 2, FLOOR)
    for _ in range(max_iter):
        grad = S - W
        while True:
            new = soft(theta - step * grad, step * rho)
            new = (new + new.T) / 2
            move = new - theta
            log_det = _log_det(new)
            now = -log_det + float((S * new).sum())
            if np.isfinite(log_det) and now <= smooth + float((grad * move).sum()) + float((move * move).sum()) / (2 * step) + 1e-12 * abs(smooth):
                break
            step /= 2
            if step < 1e-14:
                return theta
        small = float(np.abs(move).max()) <= goal * step
        before, theta, smooth = W, new, now
        W = np.linalg.inv(theta)
        W = (W + W.T) / 2
        if small:
            return theta
        bend = float((move * (before - W)).sum())
        step = min(max(float((move * move).sum()) / bend, 1e-10), 1e6) if bend > 0 else step * 2
    warnings.warn(f"the graphical lasso did not converge in {max_iter} steps", stacklevel=2)
    return theta


def denoise(theta: np.ndarray) -> np.ndarray:
    """Zeroes entries that are noise relative to the diagonal."""
    d = np.sqrt(np.maximum(np.diag(theta), FLOOR))
    out = np.where(np.abs(theta / np.outer(d, d)) < NOISE, 0.0, theta)
    out[np.diag_indices(len(out))] = np.diag(theta)
    return out


def covariance(x: np.ndarray) -> np.ndarray:
    """Of samples in rows. With missing values (NaN) each pair of features takes the samples that have both."""
    there = ~np.isnan(x)
    if there.all():
        return np.cov(x, rowvar=False)
    m = there.astype(float)
    y = np.where(there, x - np.where(there, x, 0.0).sum(0) / np.maximum(m.sum(0), 1.0), 0.0)
    n, s = m.T @ m, y.T @ m
    if n.min() < 2:
        raise np.linalg.LinAlgError("two features share less than two samples")
    return semidefinite((y.T @ y - s * s.T / n) / (n - 1))


def semidefinite(S: np.ndarray) -> np.ndarray:
    """The nearest matrix without negative eigenvalues: moments over every pair's own samples can have such."""
    value, vector = np.linalg.eigh(S)
    return S if value[0] >= 0 else (vector * np.maximum(value, 0.0)) @ vector.T


def stable_covariance(S: np.ndarray, eta: float, most_kappa: float) -> np.ndarray:
    return S + eta * np.eye(len(S)) if not np.isfinite(S).all() or np.linalg.cond(S) > most_kappa else S


def joint_fit(S: list[np.ndarray], lam: float, weights: list[np.ndarray] | None = None, eta: float = 0.01, most_kappa: float = 1e6, max_iter: int = 30, tol: float = 0.01, start: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """One precision matrix for each group's covariance. A pair that any group keeps is penalised less in all.

    start: where the first convex problem's solver begins (a neighbouring fit); it changes the time, not the solution.
    """
    p = len(S[0])
    S = [stable_covariance(s, eta, most_kappa) for s in S]
    omega = [np.linalg.inv(s) for s in S]
    weights = weights or [np.ones((p, p))] * len(S)
    last: list[np.ndarray | None] = list(start) if start else [None] * len(S)
    for _ in range(max_iter):
        V = 1.0 / np.sqrt(np.maximum(sum(np.abs(o) for o in omega), FLOOR))
        new = [glasso(s, lam * w * V, start=b) for s, w, b in zip(S, weights, last, strict=True)]
        last = new
        change = sum(np.abs(a - b).sum() for a, b in zip(new, omega, strict=True)) / max(sum(np.abs(o).sum() for o in omega), FLOOR)
        omega = new
        if change <= tol:
            break
    return [denoise(o) for o in omega]


def information(S: list[np.ndarray], n: list[int], omega: list[np.ndarray], eps: float = 1e-6, eta: float = 0.01, most_kappa: float = 1e6) -> tuple[float, float]:
    """(BIC, likelihood) of fitted precision matrices; the likelihood uses a regularised covariance where it must."""
    bic = likelihood = 0.0
    for s, nk, o in zip(S, n, omega, strict=True):
        sign, log_det = np.linalg.slogdet(o)
        if sign <= 0:
            return float("inf"), float("inf")
        edges = np.count_nonzero(np.abs(o) > eps) - len(s)
        likelihood += np.trace(stable_covariance(s, eta, most_kappa) @ o) - log_det
        bic += np.trace(s @ o) - log_det + np.log(nk) * edges / (2 * nk)
    return float(bic), float(likelihood)


def partial_correlations(S: np.ndarray, lam: float, weights: np.ndarray | float = 1.0, zero: np.ndarray | None = None, tol: float = 1e-4) -> np.ndarray:
    """Partial correlations of one group from its uncentred second moment; the diagonal is not penalised and is zero."""
    theta = glasso(S, lam * np.broadcast_to(np.asarray(weights, float), S.shape), penalize_diagonal=False, zero=zero, tol=tol)
    d = np.sqrt(np.diag(theta))
    out = -theta / np.outer(d, d)
    np.fill_diagonal(out, 0.0)
    return out
