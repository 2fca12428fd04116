"""Product codes with a learned rotation, and books for inner products.

A round is one pass over all rows, which leaves sums of a fixed size: for each slice and centre the number of its rows
and their sum, m * codes * d doubles. From these the driver takes the new centres and then the rotation nearest to
them (orthogonal Procrustes, by the singular values of a d x d matrix). Codes, centres and rotation are each the best for
the other two, so the squared error never rises from round to round.

Books for inner products weigh the part of an error along its slice by ``eta`` >= 1. A slice's centre is then the solution
of a system as wide as the slice. Defined results: null vectors take no part; there must be at least one that is not null; slices are equally wide.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.vectors import ProductQuantizer, closest, principal_rotation, rotate


def _summed(data: DataFrame, vector: str, partial: Callable[[np.ndarray], np.ndarray], at_once: int = 4096) -> np.ndarray | None:
    """The sum over all rows of an array that partial makes of some rows; one row of doubles for each task and position."""

    def run(frames):
        import pandas as pd

        total = None
        for frame in frames:
            for lo in range(0, len(frame), at_once):
                part = partial(np.asarray(frame["v"].iloc[lo : lo + at_once].tolist(), np.float64)).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "s": total})

    rows = data.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    found = rows.mapInPandas(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).toPandas()
    return found.sort_values("i")["s"].to_numpy() if len(found) else None


def _slices(books: list[np.ndarray]) -> list[slice]:
    ends = np.cumsum([b.shape[1] for b in books])
    return [slice(int(e) - b.shape[1], int(e)) for e, b in zip(ends, books, strict=True)]


def learn_rotation(data: DataFrame, m: int, codes: int, rounds: int = 8, vector: str = "embedding") -> tuple[np.ndarray, ProductQuantizer, list[float]]:
    """The rotation, its books, and the mean squared error before each round and after the last. The start are principal
    axes with books of a bounded sample; all rounds read all rows."""
    data = data.filter(F.col(vector).isNotNull())
    axes = principal_rotation(data, vector)
    pq = ProductQuantizer(m, codes).fit(rotate(data, axes, vector), vector)
    errors: list[float] = []
    for step in range(rounds + 1):
        books, parts, d = list(pq.books), _slices(pq.books), len(axes)

        def sums(x: np.ndarray, axes=axes, books=books, parts=parts, d=d) -> np.ndarray:
            turned, out, error = x @ axes, [], 0.0
            for book, part in zip(books, parts, strict=True):
                near = closest(turned[:, part], book)
                error += ((turned[:, part] - book[near]) ** 2).sum()
                mine = np.zeros((len(book), d + 1))
                np.add.at(mine, near, np.column_stack([np.ones(len(x)), x]))
                out.append(mine.ravel())
            return np.concatenate([[error, len(x)], *out])

        total = _summed(data, vector, sums)
        if total is None:
            break
        errors.append(float(total[0] / total[1]))
        if step == rounds:
            break
        place, cross, fresh = 2, np.zeros((d, d)), []
        for book, part in zip(books, parts, strict=True):
            mine = total[place : place + len(book) * (d + 1)].reshape(len(book), d + 1)
            place += mine.size
            n, by_code = mine[:, :1], mine[:, 1:]
            fresh.append(np.where(n > 0, by_code @ axes[:, part] / np.maximum(n, 1), book))
            cross[:, part] = by_code.T @ fresh[-1]
        u, _, v = np.linalg.svd(cross)
        axes, pq.books = u @ v, fresh
    return axes, pq, errors


def _losses(x: np.ndarray, book: np.ndarray, eta: float) -> np.ndarray:
    """The weighted loss of each row of a slice with each centre: |r|^2 + (eta - 1) (u r)^2, u along the row."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    u = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    along = size - u @ book.T
    return ((x[:, None] - book[None]) ** 2).sum(2) + (eta - 1) * along**2


class AnisotropicQuantizer(ProductQuantizer):
    """A product quantizer whose books and codes weigh the error along each slice by eta."""

    def __init__(self, m: int, codes: int, eta: float = 4.0, seed: int = 1):
        super().__init__(m, codes, seed)
        self.eta, self.losses = eta, []

    def fit_weighted(self, data: DataFrame, vector: str = "embedding", rounds: int = 6) -> AnisotropicQuantizer:
        """Rounds over all rows from the plain books. losses has the mean loss before each round and after the last."""
        data = data.filter(F.col(vector).isNotNull())
        self.fit(data, vector)
        for step in range(rounds + 1):
            books, parts, eta = list(self.books), _slices(self.books), self.eta

            def sums(x: np.ndarray, books=books, parts=parts, eta=eta) -> np.ndarray:
                out, loss = [], 0.0
                for book, part in zip(books, parts, strict=True):
                    some = x[:, part]
                    each = _losses(some, book, eta)
                    near = each.argmin(1)
                    loss += each[np.arange(len(some)), near].sum()
                    size = np.linalg.norm(some, axis=1, keepdims=True)
                    u = np.divide(some, size, out=np.zeros_like(some), where=size > 0)
                    w = some.shape[1]
                    mine = np.zeros((len(book), 1 + w + w * w))
                    np.add.at(mine, near, np.column_stack([np.ones(len(some)), some, (u[:, :, None] * u[:, None]).reshape(len(some), -1)]))
                    out.append(mine.ravel())
                return np.concatenate([[loss, len(x)], *out])

            total = _summed(data, vector, sums, 1024)
            if total is None:
                break
            self.losses.append(float(total[0] / total[1]))
            if step == rounds:
                break
            place, fresh = 2, []
            for book in books:
                w = book.shape[1]
                mine = total[place : place + len(book) * (1 + w + w * w)].reshape(len(book), -1)
                place += mine.size
                left = mine[:, :1, None] * np.eye(w) + (eta - 1) * mine[:, 1 + w :].reshape(-1, w, w)
                used = mine[:, 0] > 0
                centres = book.copy()
                centres[used] = np.linalg.solve(left[used], eta * mine[used, 1 : 1 + w, None])[:, :, 0]
                fresh.append(centres)
            self.books = fresh
        return self

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Negated inner products of a query's slices with all centres, so that search ranks by inner product."""
        return np.stack([-(b @ q[part]) for b, part in zip(self.books, _slices(self.books), strict=True)])

    def encode(self, data: DataFrame, vector: str = "embedding", name: str = "code") -> DataFrame:
        books, parts, eta = list(self.books), _slices(self.books), self.eta

        @F.pandas_udf("array<smallint>")
        def code(v):
            import pandas as pd

            x = np.asarray(v.tolist(), np.float64)
            out = np.empty((len(x), len(books)), np.int16)
            for lo in range(0, len(x), 1024):
                for i, (book, part) in enumerate(zip(books, parts, strict=True)):
                    out[lo : lo + 1024, i] = _losses(x[lo : lo + 1024, part], book, eta).argmin(1)
            return pd.Series(list(out))

        return data.withColumn(name, code(F.col(vector)))
