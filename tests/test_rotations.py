"""Learned rotations and weighted books: errors that never rise, against plain numpy."""

import numpy as np
import pytest

from lakeloom.operators import rotations, vectors


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    turn, _ = np.linalg.qr(rng.normal(size=(8, 8)))
    x = rng.choice([-3.0, 1.0, 4.0], size=(600, 8)) @ turn + 0.05 * rng.normal(size=(600, 8))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(700, None)], "vec_id long, embedding array<double>").repartition(3)


def test_error_never_rises_and_ends_below_the_start(data):
    x, df = data
    axes, pq, errors = rotations.learn_rotation(df, 4, 9, rounds=6)
    assert len(errors) == 7 and all(b <= a + 1e-9 for a, b in zip(errors, errors[1:], strict=False))
    assert errors[-1] < errors[0]
    assert np.allclose(axes @ axes.T, np.eye(8))
    turned = x @ axes
    plain = sum(((turned[:, 2 * i : 2 * i + 2][:, None] - b[None]) ** 2).sum(2).min(1).sum() for i, b in enumerate(pq.books)) / len(x)
    assert errors[-1] == pytest.approx(plain)


def test_weighted_books_lower_the_weighted_loss(data):
    x, df = data
    pq = rotations.AnisotropicQuantizer(4, 6, eta=4.0).fit_weighted(df, rounds=4)
    df = df.filter("embedding is not null")
    assert all(b <= a + 1e-9 for a, b in zip(pq.losses, pq.losses[1:], strict=False)) and pq.losses[-1] < pq.losses[0]
    for r in pq.encode(df).limit(50).collect():
        v = np.asarray(r["embedding"])
        for i, c in enumerate(r["code"]):
            s = v[2 * i : 2 * i + 2]
            loss = [(e := s - b) @ e + 3 * ((s / np.linalg.norm(s)) @ e) ** 2 for b in pq.books[i]]
            assert loss[c] == pytest.approx(min(loss))


def test_of_weight_one_it_is_the_plain_quantizer(data):
    _, df = data
    df = df.filter("embedding is not null")
    plain = vectors.ProductQuantizer(4, 6).fit(df)
    weighted = rotations.AnisotropicQuantizer(4, 6, eta=1.0)
    weighted.books = plain.books
    assert sorted(map(str, plain.encode(df).select("vec_id", "code").collect())) == sorted(map(str, weighted.encode(df).select("vec_id", "code").collect()))
