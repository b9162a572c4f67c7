"""Gaussian kernels by functions of one point: what their large eigenvalues are made of.

With z = sqrt(2 g) (x - middle), c = exp(-|z|^2 / 2) and u = z . z', the kernel exp(-g |x - x'|^2) is c c' exp(u). The part c c' (1 + u + u^2 / 2) is a sum of few products of a
function of each point, so that its product with a vector is linear in the points. The rest is small, positive definite, and large only among points that crowd together.
"""

import math

import numpy as np
import pandas as pd

AXES = 66  # axes of the quadratic part: 2278 functions
SAMPLE, LANDMARKS = 8192, 320  # points among which landmarks are looked for, and how many: they decide how many products a solve takes, never its result
BLOCK, PARTS = 256, 4  # functions that meet all before them in a task, and tasks that share the points of such a block
CHUNK, TASK = 1024, 8192  # points whose functions are held at once, and those of a task


class Quadratic:
    """c (1, z, z z') over the AXES principal axes of the points, all of them if there are no more."""

    def __init__(self, points: np.ndarray, gamma: float):
        self.middle, own = points.mean(axis=0), points - points.mean(axis=0)
        self.axes = (2 * gamma) ** 0.5 * (np.eye(points.shape[1]) if points.shape[1] <= AXES else np.linalg.eigh(own.T @ own)[1][:, ::-1])
        self.used = min(AXES, points.shape[1])
        self.reach = 2 * gamma * float((own * own).sum(axis=1).max(initial=0.0))
        self.i, self.j = np.triu_indices(self.used)
        self.scale = np.where(self.i == self.j, 0.5**0.5, 1.0)
        self.count = 1 + self.used + len(self.i)

    def of(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """z and c."""
        z = (points - self.middle) @ self.axes
        return z, np.exp(-0.5 * (z * z).sum(axis=1))

    def functions(self, points: np.ndarray) -> np.ndarray:
        """(functions, points)."""
        z, c = self.of(points)
        z = np.ascontiguousarray(z[:, : self.used].T)
        return np.concatenate([c[None], c * z, c * z[self.i] * (z[self.j] * self.scale[:, None])])

    def sums(self, points: np.ndarray, r: np.ndarray) -> np.ndarray:
        """functions(points) @ r for a matrix r, without the functions."""
        z, c = self.of(points)
        z, r = z[:, : self.used], c[:, None] * r
        return np.concatenate([r.sum(axis=0)[None], z.T @ r, np.stack([((z * v[:, None]).T @ z)[self.i, self.j] * self.scale for v in r.T], 1)])

    def values(self, points: np.ndarray, w: np.ndarray) -> np.ndarray:
        """functions(points).T @ w for a matrix w, without the functions."""
        z, c = self.of(points)
        z, out = z[:, : self.used], []
        for v in w.T:
            square = np.zeros((self.used, self.used))
            square[self.i, self.j] = v[1 + self.used :] * self.scale
            out.append(c * (v[0] + z @ v[1 : 1 + self.used] + ((z @ square) * z).sum(axis=1)))
        return np.stack(out, 1)


def cubic(reach: float) -> np.ndarray:
    """Coefficients, highest first, of (exp(u) - 1 - u - u^2 / 2) / u^3 for |u| <= reach <= 1, to 1e-7 of itself and the lowest degree that does."""
    exact = np.polynomial.Polynomial([1 / math.factorial(k + 3) for k in range(22)])
    at = np.linspace(-reach, reach, 500)
    for degree in range(1, 12):
        near = np.polynomial.chebyshev.Chebyshev.interpolate(exact, degree, [-reach, reach]).convert(kind=np.polynomial.Polynomial)
        if np.abs(near(at) / exact(at) - 1).max() < 1e-7:
            break
    return near.coef[::-1].astype(np.float32)


def rest_block(coefficients: np.ndarray, strip: int = 128):
    """exp(u) - 1 - u - u^2 / 2 of pairs of z in single precision: it's small, so that little is lost. A strip of rows stays in the processor's cache."""

    def block(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        q = np.ascontiguousarray(q.T)
        out, u = np.empty((len(p), q.shape[1]), np.float32), np.empty((strip, q.shape[1]), np.float32)
        for k in range(0, len(p), strip):
            g = out[k : k + strip]
            v = np.dot(p[k : k + strip], q, out=u[: len(g)])
            np.multiply(v, coefficients[0], out=g)
            for x in coefficients[1:-1]:
                g += x
                g *= v
            g += coefficients[-1]
            for _ in range(3):
                g *= v
        return out

    return block


class Features(Quadratic):
    """The quadratic part, and what landmarks tell of the rest (Nystroem), for a preconditioner. Landmarks are points of a sample with the most of the rest about them, of all points, that no landmark before tells of."""

    def __init__(self, spark, told, gamma: float):
        """told: a broadcast of the points."""
        points = told.value
        super().__init__(points, gamma)
        some = points[np.sort(np.random.default_rng(7).permutation(len(points))[:SAMPLE])]
        own = np.concatenate([self.rest(x[None], x[None])[0] for x in some])
        sample, rest = spark.sparkContext.broadcast(some), self.rest
        about = passed(spark, len(points), lambda i, j: (rest(told.value[i:j], sample.value) ** 2).sum(axis=0)[None], False, 256)[0] - own**2
        sample.destroy()
        least, found = 4 * np.median(about), []
        while len(found) < min(LANDMARKS, len(some)) and about.max() > least:
            found.append(int(np.argmax(about)))
            about[self.rest(some[found[-1:]], some)[0] ** 2 > 0.25 * own[found[-1]] * own] = 0
            about[found[-1]] = 0
        self.landmarks = some[found]
        w, v = np.linalg.eigh(self.rest(self.landmarks, self.landmarks)) if found else (np.zeros(0), np.zeros((0, 0)))
        self.mixing = (v[:, w > 1e-9] / np.sqrt(w[w > 1e-9])).T
        self.quadratic, self.count = self.count, self.count + len(self.mixing)

    def rest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The kernel of pairs without the quadratic part."""
        (z, c), (y, d) = self.of(a), self.of(b)
        v = z[:, : self.used] @ y[:, : self.used].T
        near = np.minimum(z @ y.T - 0.5 * (z * z).sum(axis=1)[:, None] - 0.5 * (y * y).sum(axis=1), 0.0)
        return np.exp(near) - c[:, None] * d * (1 + v + 0.5 * v * v)

    def functions(self, points):
        return np.concatenate([super().functions(points), self.mixing @ self.rest(self.landmarks, points)])

    def sums(self, points, r):
        return np.concatenate([super().sums(points, r), self.mixing @ (self.rest(self.landmarks, points) @ r)])

    def values(self, points, w):
        return super().values(points, w[: self.quadratic]) + self.rest(points, self.landmarks) @ (self.mixing.T @ w[self.quadratic :])


def passed(spark, n: int, answer, rows: bool, chunk: int = CHUNK) -> np.ndarray:
    """answer(first, last) for chunks of n points in tasks: added up, or (rows) one after another."""
    tasks = -(-n // TASK)

    def run(batches):
        for pdf in batches:
            for k in pdf["id"]:
                first, last = k * n // tasks, (k + 1) * n // tasks
                got = [answer(at, min(last, at + chunk)) for at in range(first, last, chunk)]
                got = np.concatenate(got) if rows else sum(got)
                yield pd.DataFrame({"k": [k], "wide": [got.shape[1]], "data": [got.tobytes()]})

    parts = sorted(spark.range(0, tasks, 1, tasks).mapInPandas(run, "k long, wide long, data binary").collect(), key=lambda x: x["k"])
    parts = [np.frombuffer(x["data"]).reshape(-1, x["wide"]) for x in parts]
    return np.concatenate(parts) if rows else sum(parts)


def both(spark, points, told, n: int, r: np.ndarray, between=lambda sums: sums) -> np.ndarray:
    """F' between(F r) for the functions F (told: a broadcast) of the points (a broadcast), and each column of r: two passes over the points, each a Spark job."""
    side = spark.sparkContext.broadcast(r.reshape(n, -1).astype(np.float64))
    w = between(passed(spark, n, lambda i, j: told.value.sums(points.value[i:j], side.value[i:j]), False))
    side.destroy()
    return passed(spark, n, lambda i, j: told.value.values(points.value[i:j], w), True).reshape(r.shape)


class Preconditioner:
    """The inverse of F' F + s I for the features F of a kernel's points, s what the diagonal has besides."""

    def __init__(self, spark, points, gamma: float, reg: float):
        features = Features(spark, points, gamma)
        self.spark, self.points, self.n, self.features = spark, points, len(points.value), spark.sparkContext.broadcast(features)
        f, n, count, blocks = self.features, self.n, features.count, -(-features.count // BLOCK)

        def run(batches):
            for pdf in batches:
                for k in pdf["id"]:
                    hi = min(count, (blocks - k // PARTS) * BLOCK)  # the widest first
                    lo, first, last = (hi - 1) // BLOCK * BLOCK, k % PARTS * n // PARTS, (k % PARTS + 1) * n // PARTS
                    total = np.zeros((hi - lo, hi))
                    for at in range(first, last, CHUNK):
                        x = f.value.functions(points.value[at : min(last, at + CHUNK)])
                        total += x[lo:hi] @ x[:hi].T
                    yield pd.DataFrame({"lo": [lo], "data": [total.tobytes()]})

        gram = np.zeros((count, count))
        for r in spark.range(0, blocks * PARTS, 1, blocks * PARTS).mapInPandas(run, "lo long, data binary").collect():
            part = np.frombuffer(r["data"]).reshape(-1, min(count, r["lo"] + BLOCK))
            gram[r["lo"] : r["lo"] + len(part), : part.shape[1]] += part
        gram = np.tril(gram) + np.tril(gram, -1).T
        self.rest = max(reg + 1.0 - np.trace(gram) / n, 1e-10)
        told = spark.sparkContext.broadcast(gram + self.rest * np.eye(count))

        def invert(batches):  # in a task, as LAPACK's threads can hang in a driver that has started a JVM since
            for pdf in batches:
                yield pd.DataFrame({"data": [np.linalg.inv(told.value).tobytes()] * len(pdf)})

        inner = np.frombuffer(spark.range(0, 1, 1, 1).mapInPandas(invert, "data binary").first()["data"]).reshape(count, count)
        told.destroy()
        self.inner = (inner + inner.T) / 2

    def __call__(self, r: np.ndarray) -> np.ndarray:
        """For a vector, or for each column of a matrix."""
        return (r - both(self.spark, self.points, self.features, self.n, r, lambda sums: self.inner @ sums)) / self.rest
