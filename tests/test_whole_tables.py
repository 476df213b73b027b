"""Queries that cover the whole table, against brute force."""

import numpy as np
import pyarrow.parquet as pq

from quire.plans import catalog
from quire.plans.transforms import cells, plane

Q = catalog.queries()


def vectors(sf_dir):
    t = pq.read_table(f"{sf_dir}/embeddings.parquet").sort_by("vec_id")
    x = np.array(t["embedding"].to_pylist(), float)
    return t["vec_id"].to_numpy(), t["label"].to_numpy(), np.array([np.sqrt(((x - r) ** 2).sum(1)) for r in x]).round(9)


def tree(ids, d):
    """Edges of the minimum spanning tree; ties by the smaller ids."""
    root, out = list(range(len(ids))), []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = np.triu_indices(len(ids), 1)
    for k in np.lexsort((b, a, d[a, b])):
        x, y = find(a[k]), find(b[k])
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(a[k]), int(b[k])))
    return out


def test_ancestry_purity(spark, sf_dir):
    ids, label, d = vectors(sf_dir)
    want = tree(ids, d)
    got = Q["ancestry_purity"](spark, sf_dir).first()
    assert got.edges == len(ids) - 1 > 200
    assert abs(got.purity - np.mean([label[a] == label[b] for a, b in want])) < 1e-6


def test_mst(spark, sf_dir):
    ids, _, d = vectors(sf_dir)
    want = sorted((int(ids[a]), int(ids[b]), round(float(d[a, b]), 6)) for a, b in tree(ids, d))
    got = sorted((r.a, r.b, r.d) for r in Q["mst"](spark, sf_dir).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=2e-6)


def test_vr_components(spark, sf_dir):
    ids, _, d = vectors(sf_dir)
    label = np.arange(len(ids))
    a, b = np.nonzero(np.triu(d < 0.9, 1))
    for x, y in zip(a, b, strict=True):
        label[label == label[y]] = label[x]
    v, e, c = len(ids), len(a), len(np.unique(label))
    assert Q["vr_components"](spark, sf_dir).first().asDict() == {"v": v, "e": e, "components": c, "loops": e - v + c}


def test_linkage_purity(spark, sf_dir):
    ids, label, d = vectors(sf_dir)
    groups = [[k] for k in range(len(ids))]
    far = d + np.where(np.eye(len(ids), dtype=bool), np.inf, 0)
    while len(groups) > 8:
        i, j = sorted(divmod(int(far.argmin()), len(far)))
        groups[i] += groups.pop(j)
        far = np.delete(np.delete(far, j, 0), j, 1)
        far[i] = [d[np.ix_(groups[i], g)].mean() for g in groups]
        far[:, i] = far[i]
        far[i, i] = np.inf
    want = sum(np.unique(label[g], return_counts=True)[1].max() for g in groups) / len(ids)
    assert abs(Q["linkage_purity"](spark, sf_dir).first().purity - want) < 1e-6


def test_residual_codec(spark, sf_dir):
    key = lambda r: (r.blk, r.i, r.j)
    want = sorted(plane(spark, sf_dir).select("blk", "i", "j", "v").collect(), key=key)
    assert sorted(Q["residual_codec"](spark, sf_dir).collect(), key=key) == want


def test_similar_region(spark, sf_dir):
    rows = cells(spark, sf_dir).select("blk", "i", "j", "v").toPandas().sort_values(["blk", "i", "j"])
    x = rows.v.to_numpy(float).reshape(-1, 8, 8)
    ids = rows.blk.to_numpy()[::64]
    small = x.reshape(-1, 4, 2, 4, 2).mean((2, 4))
    got = {(r.blk, r.pi, r.pj): r for r in Q["similar_region"](spark, sf_dir).collect()}
    assert len(got) == 4 * len(ids) and max(r.region for r in got.values()) >= 32
    for k in range(len(ids)):
        for p in range(2):
            for q in range(2):
                error = ((small - x[k, 4 * p : 4 * p + 4, 4 * q : 4 * q + 4]) ** 2).sum((1, 2)).round(9)
                r = got[ids[k], p, q]
                assert abs(r.error - error.min()) < 2e-6 and error[ids == r.region][0] <= error.min() + 1e-8
