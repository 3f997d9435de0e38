"""All-pairs results in plain numpy, straight from the definitions."""

import numpy as np


def distances(a, b, spec, jaccard="equal"):
    total = np.zeros((len(a), len(b)))
    for c in spec.numeric:
        total += np.abs(a[c].to_numpy(float)[:, None] - b[c].to_numpy(float)[None, :])
    sets = np.zeros_like(total)
    for c in spec.bitset:
        for i, x in enumerate(a[c]):
            for j, y in enumerate(b[c]):
                x, y = int(x), int(y)
                if jaccard == "equal" or not x | y:
                    sets[i, j] += x == y
                else:
                    sets[i, j] += (x & y).bit_count() / (x | y).bit_count()
    total += len(spec.bitset) - sets
    for c in spec.string:
        total += a[c].to_numpy(object)[:, None] != b[c].to_numpy(object)[None, :]
    return total


def scaled(df, columns, shift):
    out = df.copy()
    for c in columns:
        lo, hi = df[c].min(), df[c].max()
        out[c] = (df[c] - (lo if shift else 0)) / (hi - lo) if hi > lo else 0.0
    return out


def memberships(y):
    lo, hi = y.min(), y.max()
    a, b, c = (f * (hi - lo) + lo for f in (0.25, 0.5, 0.75))
    low = np.where(y <= a, 1.0, np.where(y < b, (y - b) / (a - b), 0.0))
    mid = np.where((y > a) & (y <= b), (y - a) / (b - a), 0.0)
    mid = np.where((y > b) & (y <= c), (y - c) / (b - c), mid)
    high = np.where(y >= c, 1.0, np.where(y > b, (y - b) / (c - b), 0.0))
    return np.stack([low, mid, high])


def hml(df, spec, jaccard="equal"):
    s = scaled(df, spec.numeric, False)
    sim = (spec.size - distances(s, s, spec, jaccard)) / spec.size
    lower = [np.maximum(1 - sim, c[None, :]).min(axis=1) for c in memberships(df[spec.label].to_numpy())]
    return np.max(lower, axis=0)


def owa(values):
    values = np.sort(np.asarray(values, float))
    if not len(values):
        return None
    w = 1 / np.arange(1, len(values) + 1)
    return (values * w).sum() / w.sum()


def powa(df, spec, blocks, empty=0.0, jaccard="equal"):
    s = scaled(df, (*spec.numeric, spec.label), True)
    sim = (spec.size - distances(s, s, spec, jaccard)) / spec.size
    y = s[spec.label].to_numpy()
    alike = 1 - np.abs(y[:, None] - y[None, :])
    ids = df[spec.id].to_numpy()
    block = ids % blocks
    out = []
    for i in range(len(df)):
        conflict = (sim[i] > alike[i]) & (ids != ids[i])
        degree = 1 - sim[i] + alike[i]
        parts = [owa(degree[conflict & (block == b)]) for b in sorted(set(block))]
        out.append(owa([empty if p is None else p for p in parts]))
    return np.array(out)


def nearest(tests, protos, spec, k, folds=None, jaccard="equal"):
    far = distances(tests, protos, spec, jaccard) / spec.size
    ids = protos[spec.id].to_numpy()
    out = {}
    for i, t in enumerate(tests[spec.id]):
        use = np.ones(len(ids), bool) if not folds else np.fmod(ids, folds) != np.fmod(t, folds)
        order = [j for j in np.lexsort((ids, far[i])) if use[j]][:k]
        out[t] = [(int(ids[j]), far[i, j], protos[spec.label].iloc[j]) for j in order]
    return out


def predict(near, label):
    if not near:
        return label
    d, y = np.array([n[1] for n in near]), np.array([n[2] for n in near])
    if d.max() == d.min():
        return y.mean()
    w = (d - d.min()) / (d.max() - d.min())
    return (w * y).sum() / w.sum()


def rmse(tests, protos, spec, k, folds=10):
    near = nearest(tests, protos, spec, k, folds)
    by_fold = {}
    for t, y in zip(tests[spec.id], tests[spec.label]):
        by_fold.setdefault(int(np.fmod(t, folds)), []).append((predict(near[t], y) - y) ** 2)
    return sum(np.sqrt(np.mean(e)) for e in by_fold.values()) / folds
