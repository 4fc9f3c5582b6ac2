"""Zone-map clustering and Orchard codes against brute force, and their edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest

from offerlens.llm import orchard_codes, zone_clusters
from offerlens.llm.common import stage

VECTORS = "vec_id long, embedding array<double>, label string, x string"


def kept(rows, dims, scale):
    limit = 1 << 27
    good = [r for r in rows if r[1] is not None and len(r[1]) == dims and all(v is not None and math.isfinite(v) for v in r[1])]
    return [(r[0], [math.floor(max(-limit, min(limit, scale * v))) for v in r[1]], r[2]) for r in good]


def nearest(x, centres):
    d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centres]
    return d.index(min(d)), min(d)


def moved(points, centres):
    of = [nearest(x, centres)[0] for x in points]
    out = []
    for c, old in enumerate(centres):
        mine = [x for x, o in zip(points, of) if o == c]
        out.append([sum(col) // len(mine) for col in zip(*mine)] if mine else old)
    return out


def brute_clusters(rows, dims, scale, k, rounds):
    points = kept(rows, dims, scale)
    mark = lambda p: (p[0] is None, hashlib.sha256(f"1:{p[0]}".encode()).hexdigest() if p[0] is not None else "", p[1])
    centres = [p[1] for p in sorted(points, key=mark)[:k]]
    for _ in range(rounds):
        centres = moved([p[1] for p in points], centres)
    return sorted((-1 if p[0] is None else p[0], *nearest(p[1], centres)) for p in points), centres


def brute_codes(rows, dims, scale, parts, entries, rounds):
    points, width = kept(rows, dims, scale), dims // parts
    cut = lambda x, p: x[p * width:(p + 1) * width]
    first = sorted(points, key=lambda p: (p[0] is None, p[0] or 0, p[1]))[:entries]
    books = [[cut(f[1], p) for f in first] for p in range(parts)]
    for _ in range(rounds):
        books = [moved([cut(q[1], p) for q in points], books[p]) for p in range(parts)]
    out = []
    for i, x, label in points:
        found = [nearest(cut(x, p), books[p]) for p in range(parts)]
        out.append((-1 if i is None else i, label or "", bytes(f[0] for f in found).hex(), sum(f[1] for f in found)))
    return sorted(out), books


def cloud(n, dims, seed, spread=1.0):
    random.seed(seed)
    centres = [[random.gauss(0, 3) for _ in range(dims)] for _ in range(6)]
    return [[random.gauss(m, spread) for m in centres[i % 6]] for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    some = cloud(300, 8, 1)
    out = [(i, v, "ab"[i % 2] if i % 5 else None, "clash") for i, v in enumerate(some)]
    out += [(i, [0.25] * 8, "hot", None) for i in range(1000, 1150)]  # one vector in many rows, and ties
    out += [(2000, None, "a", ""), (2001, [], "a", ""), (2002, [1.0] * 7, "a", ""), (2003, [1.0] * 7 + [None], "a", ""),
            (2004, [math.nan] * 8, "a", ""), (2005, [math.inf] + [0.0] * 7, "a", ""), (2006, [1e300] * 8, "far", ""),
            (2007, [-1e30] * 8, "far", ""), (3, some[7], "a", ""), (3, some[9], None, ""), (None, some[11], None, "")]
    random.shuffle(out)
    return out


def test_clusters_against_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(zone_clusters, "BLOCK", 16)
    table = stage(spark.createDataFrame(rows, VECTORS).repartition(5), "vectors")
    for k in (1, 5, 16):
        found, centroids = zone_clusters.cluster(table, dims=8, k=k)
        want, centres = brute_clusters(rows, 8, 64, k, 3)
        assert centroids.tolist() == centres
        assert sorted((r.id if r.id is not None else -1, r.cluster, r.distance) for r in found.collect()) == want
    full = zone_clusters.report(found, centroids).collect()
    assert len(full) == len(want)
    for r in full:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) and r.inertia == sum(d for *_, d in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()


def test_codes_against_brute_force(spark, rows):
    table = stage(spark.createDataFrame(rows, VECTORS).repartition(5), "vectors")
    for entries in (1, 7, 64):
        found, book = orchard_codes.encode(table, label_col="label", dims=8, parts=4, entries=entries)
        want, books = brute_codes(rows, 8, 256, 4, entries, 2)
        assert book.tolist() == books
        assert sorted((r.id if r.id is not None else -1, r.label or "", r.code.hex(), r.error) for r in found.collect()) == want
    errors = {}
    for _, label, _, e in want:
        errors[label] = errors.get(label, 0) + e
    for r in orchard_codes.report(found, book).join(found.select("id", "label"), "id").collect():
        assert r.id == 3 or r.label_error == errors[r.label or ""]
    plain = {r.id: [v for p, c in enumerate(r.code) for v in books[p][c]] for r in found.collect()}
    decoded = orchard_codes.decode(found, book).collect()
    assert all(r.x == plain[r.id] for r in decoded if r.id not in (3, None))


def test_no_and_few_vectors(spark):
    for some in ([], [(1, None, None, None)], [(1, [0.5] * 8, None, None), (2, [0.5] * 8, None, None)]):
        table = stage(spark.createDataFrame(some, VECTORS), "few")
        n = 2 if len(some) == 2 else 0
        clusters, centroids = zone_clusters.cluster(table, dims=8)
        assert sorted((r.id, r.cluster, r.inertia) for r in zone_clusters.report(clusters, centroids).collect()) == [(1, 0, 0), (2, 0, 0)][:n]
        codes, book = orchard_codes.encode(table, label_col="label", dims=8, parts=2)
        assert sorted((r.id, r.code, r.label_error) for r in orchard_codes.report(codes, book).collect()) == [(1, "0000", 0), (2, "0000", 0)][:n]


def test_the_curve_visits_every_cell_and_moves_one_step():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.array(np.meshgrid(*[np.arange(side)] * dims, indexing="ij")).reshape(dims, -1).T
        at = zone_clusters.hilbert_numbers(cells, bits)
        assert sorted(at.tolist()) == list(range(side ** dims))
        path = cells[np.argsort(at)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_boxes_leave_every_nearest_centroid_and_spare_others():
    rng = np.random.default_rng(2)
    spared = 0
    for _ in range(200):
        centroids = rng.integers(-50, 50, (12, 5))
        x = rng.integers(-50, 50, 5) + rng.integers(-8, 8, (30, 5))
        some = zone_clusters.candidates(x.min(0), x.max(0), centroids)
        spared += 12 - len(some)
        best, d = zone_clusters.nearest(x, centroids)
        assert set(best) <= set(some.tolist())
        again, e = zone_clusters.nearest(x, centroids[some])
        assert (some[again] == best).all() and (d == e).all()
    assert spared > 1000
    far = np.full((1, 5), 1 << 27)
    assert zone_clusters.nearest(far, np.array([[0] * 5, [1] * 5]))[1].tolist() == [5 * ((1 << 27) - 1) ** 2]


def test_orchard_compares_few_entries():
    rng = np.random.default_rng(3)
    books = orchard_codes.Codebooks(rng.integers(-300, 300, (3, 64, 4)))
    x = books.entries.transpose(1, 0, 2)[rng.integers(0, 64, 400)] + rng.integers(-20, 20, (400, 3, 4))
    codes, d = books.search(x)
    every = ((x[:, :, None] - books.entries[None]) ** 2).sum(3)
    assert (codes == every.argmin(2)).all() and (d == every.min(2)).all()
