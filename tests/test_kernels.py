import itertools
import math

import numpy as np
import pytest

from duonet.kernels import community as c
from duonet.kernels.enrichment import influence, module_tests, variances
from duonet.kernels.glasso import covariance, glasso, information, joint_fit, partial_correlations, semidefinite
from duonet.kernels.hclust import complete_linkage
from duonet.kernels.tdist import two_sided_p


def sample_cov(p, n, seed):
    x = np.random.default_rng(seed).normal(size=(n, p)) @ (np.eye(p) + 0.4 * np.tri(p, p, 1) * ~np.tri(p, p, -2, dtype=bool))
    return np.cov(x, rowvar=False)


@pytest.mark.parametrize("diagonal", [True, False])
@pytest.mark.parametrize("lam", [0.02, 0.1, 0.3])
def test_glasso_optimality(lam, diagonal):
    S = sample_cov(8, 60, 0)
    rho = np.full_like(S, lam)
    T = glasso(S, rho, penalize_diagonal=diagonal, tol=1e-7)
    W = np.linalg.inv(T)
    if not diagonal:
        np.fill_diagonal(rho, 0)
    on = np.abs(T) > 1e-8
    assert np.all(np.abs((W - S - rho * np.sign(T))[on]) < 1e-4)
    assert np.all(np.abs(W - S)[~on] <= rho[~on] + 1e-4)


def test_glasso_limits():
    S = sample_cov(6, 80, 1)
    assert np.allclose(glasso(S, 0.0), np.linalg.inv(S))
    T = glasso(S, 10.0)
    assert np.count_nonzero(T - np.diag(np.diag(T))) == 0
    order = np.array([3, 1, 5, 0, 2, 4])
    a, b = glasso(S, 0.1, tol=1e-8), glasso(S[np.ix_(order, order)], 0.1, tol=1e-8)
    assert np.allclose(a[np.ix_(order, order)], b, atol=1e-5)
    zero = np.zeros((6, 6), bool)
    zero[0, 1] = zero[1, 0] = True
    assert glasso(S, 0.01, zero=zero)[0, 1] == 0


def test_joint_fit_recovers_shared_blocks():
    rng = np.random.default_rng(3)
    P = np.eye(10)
    P[:3, :3] -= 0.4 * (1 - np.eye(3))
    cov = np.linalg.inv(P)
    S = [np.cov(rng.multivariate_normal(np.zeros(10), cov, n), rowvar=False) for n in (400, 150)]
    for o in joint_fit(S, 0.15):
        assert np.allclose(o, o.T)
        inside, outside = o[:3, :3][np.triu_indices(3, 1)], o[3:, 3:][np.triu_indices(7, 1)]
        assert np.all(inside != 0) and np.mean(outside != 0) < 0.3
    bic, like = information(S, [400, 150], joint_fit(S, 0.15))
    assert math.isfinite(bic) and bic > like - 1e9


def test_partial_correlations():
    w = partial_correlations(sample_cov(7, 90, 4), 0.05)
    assert np.allclose(w, w.T) and np.all(np.diag(w) == 0) and np.all(np.abs(w) < 1)


def test_covariance_of_pairs_with_missing_values():
    rng = np.random.default_rng(12)
    x = rng.normal(5, 2, (30, 4))
    assert np.array_equal(covariance(x), np.cov(x, rowvar=False))
    x[rng.random(x.shape) < 0.1] = np.nan
    got = covariance(x)
    for a, b in itertools.combinations_with_replacement(range(4), 2):
        both = x[~np.isnan(x[:, a]) & ~np.isnan(x[:, b])]
        assert got[a, b] == pytest.approx(np.cov(both[:, a], both[:, b])[0, 1], rel=1e-10) and got[a, b] == got[b, a]
    x[:, 0] = np.where(np.isnan(x[:, 1]), x[:, 0], np.nan)
    with pytest.raises(np.linalg.LinAlgError):
        covariance(x)
    assert np.allclose(semidefinite(np.array([[0.0, 1], [1, 0]])), 0.5)


def test_complete_linkage_properties():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = int(rng.integers(1, 8))
        d = rng.random((n, n))
        d = np.triu(d, 1) + np.triu(d, 1).T
        labels = complete_linkage(d, 0.5)
        for a, b in itertools.combinations(range(n), 2):
            if labels[a] == labels[b]:
                assert d[a, b] <= 0.5
        for x, y in itertools.combinations(set(labels), 2):  # no two clusters could still merge
            assert d[np.ix_(labels == x, labels == y)].max() > 0.5


def cliques(k, size, isolates=0):
    n = k * size + isolates
    W = np.zeros((n, n))
    for b in range(k):
        W[b * size:(b + 1) * size, b * size:(b + 1) * size] = 1
    for b in range(k - 1 + (k > 2)):
        i, j = (b + 1) * size - 1, ((b + 1) % k) * size
        W[i, j] = W[j, i] = 1
    np.fill_diagonal(W, 0)
    return W, np.repeat(np.arange(k), size)


@pytest.mark.parametrize("name", list(c.DETECTORS))
def test_detectors_find_cliques(name):
    for W, truth in (cliques(2, 6), cliques(4, 5)):
        got = c.DETECTORS[name](W, seed=1)
        assert c.modularity(W, got) >= 0.9 * c.modularity(W, truth)
        if name != "label_propagation":
            assert len(set(zip(got, truth, strict=True))) == len(set(truth))
    W, _ = cliques(2, 5, isolates=3)
    got = c.DETECTORS[name](W, seed=1)
    assert len(set(got[-3:])) == 3 and not set(got[-3:]) & set(got[:-3])
    parts = np.kron(np.eye(2), cliques(2, 5)[0])
    got = c.DETECTORS[name](parts, seed=1)
    assert not set(got[:10]) & set(got[10:])
    assert list(c.DETECTORS[name](np.zeros((3, 3)), seed=1)) == [0, 1, 2]


def test_consensus():
    m = c.consensus_matrix([np.array([0, 0, 1]), np.array([0, 1, 1])])
    assert m.tolist() == [[1, 0.5, 0], [0.5, 1, 0.5], [0, 0.5, 1]]


def test_enrichment_without_a_network_is_a_pooled_contrast():
    rng = np.random.default_rng(6)
    X = [rng.normal(0, 1, (40, 6)), rng.normal(0, 1, (30, 6))]
    X[1][:, :3] += 1.5
    mods = np.array([[1, 1, 1, 0, 0, 0], [0, 0, 0, 1, 1, 1]])
    t, dof, mu = module_tests(X, [np.zeros((6, 6))] * 2, mods)
    s2 = sum(((x - x.mean(0)) ** 2).sum() for x in X) / (6 * (39 + 29))
    want = (X[1].mean(0) - X[0].mean(0)) @ mods.T / np.sqrt(3 * s2 * (1 / 40 + 1 / 30))
    assert np.allclose(t, want, rtol=1e-6)
    p = [two_sided_p(a, b) for a, b in zip(t, dof, strict=True)]
    assert p[0] < 1e-6 < p[1]
    assert sum(variances(X, [influence(np.zeros((6, 6)))] * 2)) == pytest.approx(s2, rel=1e-3)


def test_enrichment_with_missing_values_is_their_likelihood():
    rng = np.random.default_rng(11)
    p = 5
    A = np.zeros((p, p))
    A[0, 1] = A[1, 0] = A[1, 2] = A[2, 1] = 0.4
    L = [influence(A), influence(A * 0.5)]
    X = [(f @ rng.normal(size=(p, n)) + 0.7 * rng.normal(size=(p, n))).T + 3 for f, n in zip(L, (25, 18), strict=True)]
    X[0][rng.random(X[0].shape) < 0.2] = np.nan
    X[1][4, 2] = np.nan

    def group(x, f, t):  # sample by sample: information, score, and what is left of them
        info, score, quad, log_det = np.zeros((p, p)), np.zeros(p), 0.0, 0.0
        for row in x:
            o = np.flatnonzero(~np.isnan(row))
            V = (f @ f.T + t * np.eye(p))[np.ix_(o, o)]
            Q = np.linalg.inv(V)
            info[np.ix_(o, o)] += Q
            score[o] += Q @ row[o]
            quad += row[o] @ Q @ row[o]
            log_det += np.linalg.slogdet(V)[1]
        mean = np.linalg.solve(info, score)
        return mean, info, quad - score @ mean, log_det + np.linalg.slogdet(info)[1]

    free = sum(int((~np.isnan(x)).sum()) - p for x in X)

    def profile(t):
        parts = [group(x, f, t) for x, f in zip(X, L, strict=True)]
        return free * np.log(sum(g[2] for g in parts) / free) + sum(g[3] for g in parts)

    sg, se = variances(X, L)
    t = se / sg
    assert sg == pytest.approx(sum(group(x, f, t)[2] for x, f in zip(X, L, strict=True)) / free, rel=1e-8)
    assert profile(t) <= min(profile(t * k) for k in np.exp(np.linspace(-3, 3, 25))) + 1e-9
    b = np.array([1.0, 1, 1, 0, 0])
    stat, dof, mu = module_tests(X, [A, A * 0.5], b[None])
    parts, want, var = [group(x, f, t) for x, f in zip(X, L, strict=True)], 0.0, 0.0
    for sign, f, g, m in zip((-1, 1), L, parts, mu, strict=True):
        assert np.allclose(f @ m, g[0])
        v = np.linalg.solve(f.T, (b @ f) * b)
        want, var = want + sign * v @ g[0], var + sg * v @ np.linalg.inv(g[1]) @ v
    assert stat[0] == pytest.approx(want / np.sqrt(var), rel=1e-6) and 0 < dof[0] < free
    whole = [np.where(np.isnan(x), 3.0, x) for x in X]
    almost = [whole[0], np.vstack([whole[1], np.full(p, np.nan)])]  # a sample without values changes nothing
    assert np.allclose(variances(almost, L), variances(whole, L), rtol=1e-5)
    for got, base in zip(module_tests(almost, [A, A * 0.5], b[None]), module_tests(whole, [A, A * 0.5], b[None]), strict=True):
        assert np.allclose(got, base, rtol=1e-4)


def test_null_p_values_are_uniform():
    rng = np.random.default_rng(7)
    A = np.zeros((8, 8))
    A[0, 1] = A[1, 0] = A[2, 3] = A[3, 2] = 0.3
    L = influence(A)
    p = []
    for _ in range(150):
        X = [(L @ rng.normal(size=(8, n)) + 0.3 * rng.normal(size=(8, n))).T for n in (30, 30)]
        t, d, _ = module_tests(X, [A, A], np.array([[1, 1, 1, 1, 0, 0, 0, 0]]))
        p.append(two_sided_p(t[0], d[0]))
    assert abs(np.mean(p) - 0.5) < 0.1 and np.mean(np.array(p) < 0.1) < 0.2


def test_student_p():
    assert two_sided_p(0, 5) == pytest.approx(1)
    assert two_sided_p(2.570581836, 5) == pytest.approx(0.05, rel=1e-6)
    assert two_sided_p(12.70620474, 1) == pytest.approx(0.05, rel=1e-6)
    assert two_sided_p(1.959963985, 1e7) == pytest.approx(0.05, rel=1e-4)
