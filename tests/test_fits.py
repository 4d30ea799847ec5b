"""The model fits against a search of every point of every grid."""

import numpy as np

from faintdip.operators import detect


def plain(shape, t, f, grids, rounds=6):
    low, high = np.array([g[0] for g in grids]), np.array([g[-1] for g in grids])
    points = [np.asarray(g, float) for g in grids]
    best = (np.inf, None, 0.0)
    for _ in range(rounds):
        mesh = np.stack([m.ravel() for m in np.meshgrid(*points, indexing="ij")], 1)
        phi = shape(t[None], *(mesh[:, i : i + 1] for i in range(mesh.shape[1])))
        size = (phi * phi).sum(1)
        d = np.clip(np.divide(((1 - f) * phi).sum(1), size, out=np.zeros(len(mesh)), where=size > 0), 0, 1)
        cost = ((f - 1 + d[:, None] * phi) ** 2).sum(1)
        k = int(np.argmin(cost))
        if cost[k] < best[0]:
            best = (float(cost[k]), mesh[k], float(d[k]))
        step = [(p[1] - p[0] if len(p) > 1 else 0) for p in points]
        points = [np.clip(np.linspace(c - s, c + s, 7), a, b) for c, s, a, b in zip(best[1], step, low, high)]
    return best


def bell(t, at, width):
    return np.exp(-0.5 * ((t - at) / width) ** 2)


def ramps(t, at, rise, fall):
    x = t - at
    return np.clip(np.where(x <= 0, 1 + x / rise, 1 - x / fall), 0, 1)


def test_fits_are_those_of_the_whole_grids_with_few_residuals():
    rng, picked, whole = np.random.default_rng(5), 0, 0

    def counted(model):
        def run(*args):
            nonlocal whole
            size, along, shapes = model(*args)
            whole += size.size

            def some(*at):
                nonlocal picked
                picked += len(at[0])
                return shapes(*at)

            return size, along, some

        return run

    for n in (5, 8, 12, 40, 130):
        for kind in ("noise", "dip", "spike"):
            t = np.sort(rng.uniform(0, 5, n))
            f = 1 - {"noise": rng.normal(0, 0.1, n), "dip": 0.3 * ramps(t, 2.5, 0.5, 1.5), "spike": 0.2 * (np.arange(n) == n // 2)}[kind]
            at, wide = np.linspace(0, 5, 11), np.geomspace(0.1, 2.5, 6)
            for model, shape, grids in ((detect.gaussian, bell, [at, wide]), (detect.triangle, ramps, [at, wide, 2 * wide])):
                got, want = detect._best(counted(model), t, f, grids), plain(shape, t, f, grids)
                assert got[0] == want[0] and list(got[1]) == list(want[1]) and got[2] == want[2], (n, kind, shape)
    assert picked < whole / 5
