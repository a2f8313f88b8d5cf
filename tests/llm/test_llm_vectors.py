import tracemalloc

import numpy as np
import pytest

from lakevec.llm import cftree, clusters, neighbours
from lakevec.llm import vectors as V

SEGMENT = "segment_id long, table_name string, metric string, vectors array<float>, keys array<long>, deleted array<boolean>, label string"
COLLECTION = "table_name string, column_name string, dimension int, metric string, top_k int, min_score double"


def naive_ward(n, c, groups):
    parts = [[i] for i in range(len(n))]
    while len(parts) > groups:
        best = None
        for i in range(len(parts)):
            for j in range(i):
                a, b = n[parts[i]].sum(), n[parts[j]].sum()
                x, y = (c[parts[i]] * n[parts[i], None]).sum(0) / a, (c[parts[j]] * n[parts[j], None]).sum(0) / b
                d = a * b / (a + b) * ((x - y) ** 2).sum()
                if best is None or d < best[0]:
                    best = (d, i, j)
        parts[best[2]] += parts.pop(best[1])
    return sorted(map(sorted, parts))


@pytest.mark.parametrize("seed", range(4))
def test_ward_is_ward(seed):
    r = np.random.default_rng(seed)
    n, c = r.integers(1, 6, 30).astype(float), r.normal(size=(30, 3))
    label = cftree.ward(n, c, 7)
    assert sorted(list(np.flatnonzero(label == k)) for k in range(7)) == naive_ward(n, c, 7)


def test_trees_merge_and_stay_bounded():
    r = np.random.default_rng(1)
    x = r.normal(size=(6000, 12))
    a, b = cftree.CFTree(12, 0.1, 200), cftree.CFTree(12, 0.1, 200)
    a.add(x[:3000])
    b.add(x[3000:])
    a.insert(*b.leaves())
    n, ls, ss = a.leaves()
    assert 50 < len(n) <= 200 and n.sum() == 6000
    assert np.allclose(ls.sum(axis=0), x.sum(axis=0)) and np.isclose(ss.sum(), (x * x).sum())
    same = cftree.CFTree(3, 0.1, 64)
    same.add(np.ones((5000, 3)))
    assert len(same.leaves()[0]) == 1


def test_packing():
    m = np.array([[0.5, -2.0], [0.1, 3.0], [70000.0, 0.0]], dtype=np.float32)
    packed = V.pack(m)
    assert [len(p) for p in packed] == [4, 8, 8] and (V.unpack(packed, 2) == m).all()


def test_footrule():
    r = np.random.default_rng(2)
    perm = np.array([r.permutation(20)[:8] for _ in range(40)], dtype=np.uint16)
    near = neighbours.footrule(perm, np.arange(40))
    assert (neighbours.footrule(perm, np.array([5, 3])) == near[[5, 3]]).all()
    place = lambda p, x: list(p).index(x) if x in p else 8
    for i in range(0, 40, 7):
        for j in range(40):
            far = sum(abs(place(perm[i], x) - place(perm[j], x)) for x in set(perm[i]) | set(perm[j]))
            assert 2 * near[i, j] == 72 - far


def test_blocks():
    arrays = [np.arange(5), np.zeros((0, 3), dtype=np.float16), np.eye(3, dtype=np.float32), np.array([1, 2], dtype=np.uint16)]
    back = neighbours.from_block(neighbours.to_block(arrays))
    assert all((a == b).all() and a.dtype == b.dtype and a.shape == b.shape for a, b in zip(arrays, back))


def data(seed=0, groups=60, noise=80, dim=16):
    """Tight groups of unit vectors that are far from each other, single ones, copies, zeros; a third of all in one group."""
    r = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = r.normal(size=dim)
        for _ in range(400 if g == 0 else r.integers(2, 12)):
            v = centre / np.linalg.norm(centre) + r.normal(size=dim) * 0.02
            rows.append(v * (r.uniform(0.5, 3) if g % 2 else 1))
    rows += [r.normal(size=dim) for _ in range(noise)] + [np.zeros(dim)] * 3 + [rows[50]] * 40
    m = np.array(rows, dtype=np.float16).astype(np.float32)
    keys = r.permutation(10 * len(m))[: len(m)]
    deleted = r.random(len(m)) < 0.05
    return keys, m, deleted


def tables(spark, keys, m, deleted, dim=16):
    segs, size = [], 70
    for s, at in enumerate(range(0, len(m), size)):
        e = slice(at, at + size)
        segs.append((s, "t", "COSINE", m[e].ravel().tolist(), keys[e].tolist(), deleted[e].tolist(), "x"))
    segs += [segs[2], (900, "unknown", None, [1.0] * dim, [7], [False], "x"), (901, "t", None, None, None, None, None), (902, "t", None, [], [], [], None), (903, "t", "l2", [float("nan")] * dim, [10**7], [False], None)]
    cols = [("t", "v", dim, "cosine", 4, 0.9), ("empty", "v", 3, "l2", 2, -1.0)]
    return spark.createDataFrame(segs, SEGMENT).repartition(4), spark.createDataFrame(cols, COLLECTION)


def score(a, b, metric="cosine"):
    return V.scores(V.comparable(a, metric).astype(float), V.comparable(b, metric).astype(float), metric).round(9)


def pairs_on(r, n, dim, cosine):
    """n pairs of unit vectors, all in random directions, of just so much cosine or a little more."""
    a = r.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.normal(size=(n, dim))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = cosine + 0.004
    return np.stack([a, c * a + np.sqrt(1 - c * c) * b], axis=1).reshape(-1, dim).astype(np.float32)


@pytest.mark.parametrize("metric", ["cosine", "l2", "inner"])
def test_no_pair_is_lost_between_regions(spark, monkeypatch, metric):
    """Pairs at cosine 0.7 in 200 regions, in several blocks of the exact comparison; their two vectors often have different regions."""
    monkeypatch.setattr(clusters, "PER_REGION", 40)
    monkeypatch.setattr(clusters, "SUPER", 1500)
    dim, n = 64, 4000
    m = pairs_on(np.random.default_rng(3), n, dim, 0.7)
    keys = np.random.default_rng(4).permutation(len(m))
    least = {"cosine": 0.7, "inner": 0.7, "l2": -float(np.sqrt(2 - 2 * 0.7))}[metric]
    segs = [(s, "t", metric, m[at : at + 500].ravel().tolist(), keys[at : at + 500].tolist(), None, "x") for s, at in enumerate(range(0, len(m), 500))]
    known = [V.Collection("t", dim, metric, 4, least)]
    df = spark.createDataFrame(segs, SEGMENT).repartition(4)
    centres = clusters.region_centres(df, known)
    assert len(centres[0]) > 190
    near = clusters._nearest(m, centres[0])[0].reshape(-1, 2)
    assert (near[:, 0] != near[:, 1]).mean() > 0.5
    found = clusters.cluster(df, spark.createDataFrame([("t", "v", dim, metric, 4, least)], COLLECTION))
    got = {(r.label, r.key) for r in clusters.members(found).collect()}
    assert got == {(min(p), int(k)) for p in keys.reshape(-1, 2) for k in p}


def test_regions_out_of_reach_are_not_compared():
    centres = np.array([[0.0, 0.0], [10.0, 0.0], [11.0, 0.0]], dtype=np.float32)
    far = clusters._reach(V.Collection("t", 2, "l2", 1, -1.0), centres, [0, 1, 2], np.array([1.0, 1.0, 1.0]), np.zeros(3))
    assert far.may.tolist() == [[True, False, False], [False, True, True], [False, True, True]]
    dot = clusters._reach(V.Collection("t", 2, "inner", 1, 50.0), centres, [0, 1, 2], np.array([1.0, 1.0, 1.0]), np.array([1.0, 11.0, 12.0]))
    assert not dot.may[0, 0] and not dot.may[0, 2] and dot.may[1, 2]


def test_labels_of_a_long_chain(spark):
    links = spark.createDataFrame([(0, i + 1, i) for i in range(300)] + [(1, 7, 3)], "tab int, key long, root long")
    assert {(r.tab, r.key, r.label) for r in clusters._smallest_labels(links).collect()} == {(0, i, 0) for i in range(301)} | {(1, 7, 3), (1, 3, 3)}


@pytest.fixture(scope="module")
def case():
    return data()


def test_clusters_are_exact(spark, case, monkeypatch):
    monkeypatch.setattr(clusters, "PER_REGION", 60)
    monkeypatch.setattr(clusters, "REGION_LIMIT", 40)
    monkeypatch.setattr(clusters, "FAN_IN", 2)
    keys, m, deleted = case
    segs, cols = tables(spark, *case)
    k, x = keys[~deleted], m[~deleted]
    similar = score(x, x) >= 0.9
    np.fill_diagonal(similar, False)
    want = {(int(min(k[i], k[similar[i]].min())), int(k[i])) for i in range(len(k)) if similar[i].any()}
    found = clusters.cluster(segs, cols)
    assert {(r.label, r.key) for r in clusters.members(found).collect()} == want
    sizes = {}
    for c, _ in want:
        sizes[c] = sizes.get(c, 0) + 1
    described = {r.cluster_key: r for r in clusters.describe(segs, found).collect()}
    assert {c: r.size for c, r in described.items()} == sizes
    place = {int(v): i for i, v in enumerate(k)}
    for c, r in list(described.items())[:20]:
        mine = sorted(v for d, v in want if d == c)
        u = V.comparable(x[[place[v] for v in mine]], "cosine")
        far = np.sqrt(((u - u.mean(axis=0)) ** 2).sum(axis=1))
        assert np.allclose(far[[mine.index(v) for v in r.typical_keys]], np.sort(far)[: len(r.typical_keys)], atol=1e-6)


def test_no_vectors(spark):
    segs, cols = tables(spark, *data())
    found = clusters.cluster(segs.limit(0), cols)
    assert clusters.members(found).count() == 0
    assert neighbours.nearest_pairs(neighbours.vector_rows(segs.limit(0), None, None), cols).count() == 0
    assert clusters.members(clusters.cluster(segs, cols.limit(0))).count() == 0


def best(k, x, metric, top, least):
    s = score(x, x, metric)
    np.fill_diagonal(s, -np.inf)
    out = {}
    for i in range(len(k)):
        order = sorted(range(len(k)), key=lambda j: (-s[i, j], k[j]))[:top]
        out[int(k[i])] = [int(k[j]) for j in order if s[i, j] >= least]
    return out


@pytest.mark.parametrize(("metric", "least"), [("cosine", 0.9), ("l2", -1.0), ("inner", 0.8)])
def test_recall_against_brute_force(spark, metric, least):
    keys, m, deleted = data(3)
    if metric == "inner":
        m = V.comparable(m, "cosine").astype(np.float16).astype(np.float32)
    segs, _ = tables(spark, keys, m, deleted)
    cols = spark.createDataFrame([("t", "v", 16, metric, 4, least)], COLLECTION)
    extra = [(1, "t", 10**6 + i, v, "v") for i, v in enumerate(([1.0] * 16, None, [1.0] * 15, [float("inf")] * 16, [1.0] * 16, [None] * 16))]
    ups = spark.createDataFrame([*extra, extra[0], (9, None, 5, [1.0] * 16, None), (9, "t", None, [1.0] * 16, None)], "request_id long, table_name string, id long, vector array<float>, column_name string")
    found = {(r.id_a, r.id_b) for r in neighbours.nearest_pairs(neighbours.vector_rows(segs, ups, None), cols).collect()}
    k = np.concatenate([keys[~deleted], [10**6, 10**6 + 4]])
    x = np.concatenate([m[~deleted], np.ones((2, 16), dtype=np.float32)])
    want = {(min(a, b), max(a, b)) for a, others in best(k, x, metric, 4, least).items() for b in others}
    assert len(want & found) >= 0.9 * len(want)
    assert len(found - want) <= 0.1 * len(found)
    assert (10**6, 10**6 + 4) in found


def test_copies_are_each_others_nearest(spark):
    """One vector under a third of all ids: its copies follow the smallest ones, also across tasks."""
    keys, m, _ = data(5)
    m[: len(m) // 3] = m[0]
    deleted = np.zeros(len(m), dtype=bool)
    segs, _ = tables(spark, keys, m, deleted)
    cols = spark.createDataFrame([("t", "v", 16, "cosine", 4, 0.9)], COLLECTION)
    found = {(r.id_a, r.id_b) for r in neighbours.nearest_pairs(neighbours.vector_rows(segs, None, None), cols).collect()}
    same = sorted(int(v) for v in keys[(m == m[0]).all(axis=1)])
    for v in same:
        for b in [u for u in same if u != v][:4]:
            assert (min(v, b), max(v, b)) in found


def test_followers_of_dropped_leaders_keep_their_pairs(spark):
    """Copies in more tasks than top_k + 1, more than top_k + 1 in each, ids ordered by task: most leaders follow another task's."""
    r = np.random.default_rng(8)
    tasks, top = 8, 4
    rows = []
    for t in range(tasks):
        m = np.concatenate([np.ones((12, 16)), r.normal(size=(5, 16))]).astype(np.float16).astype(np.float32)
        rows.append((t, "t", "cosine", m.ravel().tolist(), list(range(100 * t, 100 * t + 17)), [False] * 17, "x"))
    segs = spark.createDataFrame(spark.sparkContext.parallelize(rows, tasks), SEGMENT)
    cols = spark.createDataFrame([("t", "v", 16, "cosine", top, 0.9)], COLLECTION)
    found = {(x.id_a, x.id_b) for x in neighbours.nearest_pairs(neighbours.vector_rows(segs, None, None), cols).collect()}
    same = [100 * t + i for t in range(tasks) for i in range(12)]
    want = {(min(v, b), max(v, b)) for v in same for b in [u for u in same if u != v][:top]}
    assert found == want


def test_repeated_segments_count_once(spark, monkeypatch):
    """Each task has a segment of its own and one that is in every task; in each the repeated keys have another leader."""
    monkeypatch.setattr(clusters, "PER_REGION", 20)
    r = np.random.default_rng(9)
    centres = r.normal(size=(12, 16))
    near = lambda n: np.array(centres[np.arange(n) % 12] + r.normal(size=(n, 16)) * 0.02, dtype=np.float16).astype(np.float32)
    again, tasks = near(24), 4
    rows = []
    for t in range(tasks):
        m = near(12)
        # the last task's own keys are greater, so that the repeated ones lead there
        keys = [1000 - 200 * t + i if t < tasks - 1 else 5000 + i for i in range(12)]
        rows += [[(t, "t", "cosine", m.ravel().tolist(), keys, [False] * 12, "x"), (90, "t", "cosine", again.ravel().tolist(), list(range(2000, 2024)), [False] * 24, "x")]]
    segs = spark.createDataFrame(spark.sparkContext.parallelize(rows, tasks).flatMap(lambda x: x), SEGMENT)
    cols = spark.createDataFrame([("t", "v", 16, "cosine", 4, 0.9)], COLLECTION)
    found = clusters.cluster(segs, cols)
    everything = [k for x in rows for k in x[0][4]] + rows[0][1][4]
    assert sorted(v.key for v in found.vectors.collect()) == sorted(everything)
    # of the smallest task's keys each leads the cluster of its centre
    want = sorted((600 + i % 12, k) for x in [*(y[0][4] for y in rows), rows[0][1][4]] for i, k in enumerate(x))
    assert sorted((v.label, v.key) for v in clusters.members(found).collect()) == want
    assert {v.cluster_key: v["size"] for v in clusters.describe(segs, found).collect()} == {600 + i: 6 for i in range(12)}


def test_leader_that_follows_in_another_block_takes_its_cluster_along(spark):
    """The repeated vector b leads c in one task and follows a in the other; a and c aren't similar."""
    at = lambda deg: [float(np.cos(np.radians(deg))), float(np.sin(np.radians(deg)))]
    b = (1, "t", "cosine", at(20), [2], [False], "x")
    one = [(0, "t", "cosine", at(0), [1], [False], "x"), b]
    two = [b, (2, "t", "cosine", at(40), [3], [False], "x")]
    segs = spark.createDataFrame(spark.sparkContext.parallelize([one, two], 2).flatMap(lambda x: x), SEGMENT)
    cols = spark.createDataFrame([("t", "v", 2, "cosine", 4, float(np.cos(np.radians(25))))], COLLECTION)
    assert sorted((v.label, v.key) for v in clusters.members(clusters.cluster(segs, cols)).collect()) == [(1, 1), (1, 2), (1, 3)]


def clouds(n=6000, dim=16, groups=40, seed=11):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    m = centres[r.integers(0, groups, n)] + r.normal(size=(n, dim)) * 0.25
    return np.arange(n) * 7 + 3, m.astype(np.float16).astype(np.float32)


def recall(keys, m, found, metric, top, least):
    """Of the top others from least on of the vectors with an id divisible by 20, the part that was found."""
    x = V.comparable(m, metric).astype(float)
    hit = n = 0
    for i in np.flatnonzero(keys % 20 == 0):
        s = V.scores(x[i : i + 1], x, metric)[0].round(9)
        s[i] = -np.inf
        for j in np.lexsort((keys, -s))[:top]:
            if s[j] >= least:
                n += 1
                hit += (min(keys[i], keys[j]), max(keys[i], keys[j])) in found
    assert n > 100
    return hit / n


@pytest.mark.parametrize(("metric", "least"), [("cosine", 0.7), ("l2", -1.5), ("inner", 10.0)])
def test_candidates_are_ranked_by_footrule_before_they_are_scored(monkeypatch, metric, least):
    """Most inverted files have more vectors than are scored."""
    monkeypatch.setattr(neighbours, "PER_PIVOT", 80)
    monkeypatch.setattr(neighbours, "CANDIDATES", 160)
    ranked, real = [], neighbours.footrule
    monkeypatch.setattr(neighbours, "footrule", lambda perm, rows: ranked.append(len(perm)) or real(perm, rows))
    keys, m = clouds()
    a, b, _ = neighbours.search_bucket(keys, m, V.Collection("t", 16, metric, 5, least))
    assert len(set(ranked)) > 10 and len(ranked) > 0.5 * len(keys) / 80
    found = {(min(x, y), max(x, y)) for x, y in zip(keys[a].tolist(), keys[b].tolist())}
    assert recall(keys, m, found, metric, 5, least) >= 0.9


def test_scored_candidates_of_a_vector_are_bounded(monkeypatch):
    """Twice as many vectors in the same space: no more scores for each."""
    monkeypatch.setattr(neighbours, "CANDIDATES", 64)
    for n in (3000, 6000):
        keys, m = clouds(n, groups=2)
        scored, real = [0], neighbours._best_in_file

        def count(x, perm, q, *rest):
            scored[0] += len(q) * min(len(x), 64)
            return real(x, perm, q, *rest)

        monkeypatch.setattr(neighbours, "_best_in_file", count)
        neighbours.search_bucket(keys, m, V.Collection("t", 16, "cosine", 5, 0.7))
        monkeypatch.setattr(neighbours, "_best_in_file", real)
        assert scored[0] <= neighbours.SEARCHED * 64 * n


def test_levels_grow_instead_of_buckets():
    for n in (0, 1, 10**5, 10**7, 10**9, 10**12):
        parts = neighbours.levels(n)
        assert max(parts) <= neighbours.MOST_PIVOTS // neighbours.PIVOTS_PER_BUCKET
        assert n * neighbours.SPREAD ** len(parts) / np.prod(parts, dtype=float) <= neighbours.PER_BUCKET + 1
    assert [len(neighbours.levels(n)) for n in (10**5, 10**8, 10**11)] == [1, 2, 3]


def test_two_levels_of_routing(spark, monkeypatch):
    """Small buckets and few pivots, so that a level is too small: the second one takes its pivots from each bucket."""
    monkeypatch.setattr(neighbours, "PER_BUCKET", 600)
    monkeypatch.setattr(neighbours, "MOST_PIVOTS", 32)
    keys, m = clouds(4000)
    assert len(neighbours.levels(4000)) >= 2
    segs, _ = tables(spark, keys, m, np.zeros(len(m), dtype=bool))
    cols = spark.createDataFrame([("t", "v", 16, "cosine", 4, 0.7)], COLLECTION)
    found = {(r.id_a, r.id_b) for r in neighbours.nearest_pairs(neighbours.vector_rows(segs, None, None), cols).collect()}
    assert recall(keys, m, found, "cosine", 4, 0.7) >= 0.9


def test_a_hot_vector_is_not_gathered(spark, monkeypatch):
    """A third of all ids have one vector, in every block more than top_k + 1 of them; each gets its smallest copies."""
    monkeypatch.setattr(neighbours, "BLOCK", 140)
    keys, m, _ = data(5)
    m[: len(m) // 3] = m[0]
    segs, _ = tables(spark, keys, m, np.zeros(len(m), dtype=bool))
    cols = spark.createDataFrame([("t", "v", 16, "cosine", 4, 0.9)], COLLECTION)
    found = {(r.id_a, r.id_b) for r in neighbours.nearest_pairs(neighbours.vector_rows(segs, None, None), cols).collect()}
    same = sorted(int(v) for v in keys[(m == m[0]).all(axis=1)])
    for v in same:
        for b in [u for u in same if u != v][:4]:
            assert (min(v, b), max(v, b)) in found


@pytest.mark.parametrize("metric", ["cosine", "inner", "l2"])
def test_nearest_pivots_with_ties_and_sums_beyond_single_precision(metric):
    """Equal pivots in order of their places; products of large elements are infinite or undefined."""
    r = np.random.default_rng(4)
    x = r.integers(-2, 3, size=(300, 6)).astype(np.float32)
    pivots = np.concatenate([x[:40], x[:10], np.zeros((2, 6), dtype=np.float32)])
    far = -(x @ pivots.T) + (0.5 * (pivots * pivots).sum(axis=1) if metric == "l2" else 0)
    for k in (1, 3, 8, 60):
        assert (neighbours.permutations(x, pivots, metric, k) == np.argsort(far, axis=1, kind="stable")[:, :k]).all()
    x[7], x[8], pivots[3], pivots[4] = 3e30, np.float32([3e30, -3e30] * 3), 2e30, np.float32([2e30, -2e30] * 3)
    with np.errstate(over="ignore", invalid="ignore"):
        odd = neighbours.permutations(x, pivots, metric, 8)
    assert all(len(set(p)) == 8 and max(p) < len(pivots) for p in odd.tolist())


def test_the_nearest_by_footrule_are_scored_in_blocks():
    """Each row gets all of its CANDIDATES nearest, a bounded number together, and no copy of them for each row."""
    r = np.random.default_rng(6)
    x = r.normal(size=(3000, 96)).astype(np.float32)
    perm = neighbours.permutations(x, x[:60], "l2", 8)
    q = np.arange(0, 3000, 3)
    near = dict(zip(q.tolist(), neighbours.footrule(perm, q)))
    seen = []
    for rows, cand in neighbours._candidates(perm, q):
        seen += rows.tolist()
        cand = np.arange(len(x)) if cand is None else cand
        assert len(rows) <= neighbours.TOGETHER and len(cand) <= neighbours.TOGETHER * neighbours.CANDIDATES
        for i in rows.tolist():
            surely = np.flatnonzero(near[i] > np.sort(near[i])[-neighbours.CANDIDATES])
            assert np.isin(surely, cand).all()
    assert sorted(seen) == q.tolist()
    exactly = neighbours._nearest(np.stack(list(near.values())), neighbours.CANDIDATES)
    assert (exactly.sum(axis=1) == neighbours.CANDIDATES).all()


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_ranked_files_do_not_copy_their_candidates_for_each_row(metric):
    r = np.random.default_rng(7)
    x = V.comparable(r.normal(size=(1500, 96)), "cosine").astype(np.float32)
    perm, q = neighbours.permutations(x, x[:50], metric, 8), np.arange(1500)
    tracemalloc.start()
    found = 0
    for a, b, s in neighbours._best_in_file(x, perm, q, metric, 5, -2.0):
        assert (a != b).all() and np.isfinite(s).all()
        found += len(a)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # before, 42 rows had 512 vectors of 96 numbers each, 8 MB
    assert found >= 5 * len(q) and peak < 8e6


def test_the_hash_of_pivots_is_sparks(spark):
    """So rows without a pivot are left out before they go to Python."""
    ids = np.array([0, 1, -1, 42, 2**63 - 1, -(2**63), *np.random.default_rng(1).integers(-(2**62), 2**62, 500)])
    df = spark.createDataFrame([("t", [int(i), None]) for i in ids], "table_name string, keys array<long>")
    want = [r.h for r in df.selectExpr("xxhash64(keys[0]) AS h").collect()]
    assert neighbours._xxhash64(ids).view(np.int64).tolist() == want
    for rate in (0.0, 0.3, 0.999, 1.0):
        alone = df.selectExpr("table_name", "array(keys[0]) AS keys")
        assert [r.low for r in alone.select(neighbours._has_below("t", rate).alias("low")).collect()] == neighbours._below(ids, rate).tolist()
    assert not alone.select(neighbours._has_below("u", 1.0).alias("low")).filter("low").count()


def test_followers_pass_two_levels_and_vectors_are_not_read_for_them(spark, monkeypatch, tmp_path):
    """Copies in several tasks and levels; what is left to do after posting reads no vectors."""
    monkeypatch.setattr(neighbours, "PER_BUCKET", 600)
    monkeypatch.setattr(neighbours, "MOST_PIVOTS", 32)
    keys, m = clouds(4000)
    m[::3] = m[0]
    assert len(neighbours.levels(len(m))) >= 2
    segs, _ = tables(spark, keys, m, np.zeros(len(m), dtype=bool))
    segs.write.parquet(str(tmp_path / "segs"))
    segs = spark.read.parquet(str(tmp_path / "segs"))
    cols = spark.createDataFrame([("t", "v", 16, "cosine", 4, 0.7)], COLLECTION)
    result = neighbours.nearest_pairs(neighbours.vector_rows(segs, None, None), cols)
    assert result.inputFiles() and not any(str(tmp_path) in f for f in result.inputFiles())
    pairs = result.collect()
    found = {(r.id_a, r.id_b) for r in pairs}
    assert len(found) == len(pairs) and recall(keys, m, found, "cosine", 4, 0.7) >= 0.9
    same = sorted(int(v) for v in keys[(m == m[0]).all(axis=1)])
    for v in same:
        for b in [u for u in same if u != v][:4]:
            assert (min(v, b), max(v, b)) in found


def test_descending_in_groups():
    r = np.random.default_rng(3)
    a, x = np.sort(r.integers(0, 50, 3000)), r.normal(size=3000).astype(np.float32)
    x[:6] = [0, -0.0, np.inf, -np.inf, 1e-40, -1e-40]
    assert (neighbours._descending(a, x) == x[np.lexsort((-x, a))]).all()
