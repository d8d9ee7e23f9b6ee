"""Every link is found, whatever the spread of the vectors, their length and the layout of the tables."""

import numpy as np
import pytest

from quillsieve.llm import itq_dedup


def vectors(kind, size, n=400, seed=3):
    """Random unit vectors and for each some neighbours, at cosines from 0.97 to 0.99."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, size))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    if kind == "mean":
        centre = np.eye(size)[0]
        base = 0.95 * centre + np.sqrt(1 - 0.95**2) * base
        base /= np.linalg.norm(base, axis=1, keepdims=True)
    out = [base]
    for cosine in (0.9801, 0.985, 0.975):
        way = rng.normal(size=base.shape)
        way -= (way * base).sum(1, keepdims=True) * base
        way /= np.linalg.norm(way, axis=1, keepdims=True)
        out.append(cosine * base + np.sqrt(1 - cosine**2) * way)
    return np.concatenate(out).astype(np.float32)


@pytest.mark.parametrize(("kind", "size", "layout"), [("isotropic", 64, None), ("isotropic", 64, (4, 16)), ("isotropic", 64, (1, 8)), ("mean", 64, None), ("mean", 64, (8, 8)), ("isotropic", 8, None), ("isotropic", 256, None)])
def test_every_link_is_found(spark, kind, size, layout):
    x = vectors(kind, size)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    got = {r["vec_id"]: r for r in itq_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), layout=layout).collect()}
    d = x.astype(np.float64)
    near = (d @ d.T) / np.sqrt(np.outer((d * d).sum(1), (d * d).sum(1))) >= 0.98
    label = np.arange(len(x)) % 2
    near &= (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    assert near.sum() > 700
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(1).tolist()
    component = np.arange(len(x))
    while (least := np.where(near, component[None], len(x)).min(1)) is not None and (np.minimum(component, least) < component).any():
        component = np.minimum(component, least)
    assert [got[i]["component_id"] for i in range(len(x))] == component.tolist()
