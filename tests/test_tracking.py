"""Assignment, event fold and metrics on small inputs with known results."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lensfold.operators import boxes, hota, mot_events, mot_metrics, tracker
from lensfold.operators.assignment import assign, assign_groups, available_solvers, default_solver, heaviest_matching, heaviest_pairs, register_solver, shortest_paths
from lensfold.operators.components import connected_components

N = np.nan

def test_assignment_of_odd_matrices():
    """Empty and forbidden matrices give no pairs, a forbidden row or column none of its own, and the matrix stays as it is."""
    assert assign(np.empty((0, 0))) == assign(np.empty((0, 3))) == assign(np.full((2, 3), N)) == []
    rng = np.random.default_rng(7)
    cost = rng.normal(size=(5, 6))
    cost[2], cost[:, 4] = N, np.inf
    before = cost.copy()
    pairs = assign(cost)
    np.testing.assert_array_equal(cost, before)
    assert {i for i, _ in pairs} == {0, 1, 3, 4} and 4 not in {j for _, j in pairs}
    assert assign(cost * 12.5) == pairs and sorted((j, i) for i, j in assign(cost.T)) == sorted((i, j) for i, j in pairs)


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, m = rng.integers(1, 6, 2)
        cost = rng.integers(-4, 9, (n, m)).astype(float)
        cost[rng.random((n, m)) < 0.3] = N
        wide = cost if n <= m else cost.T
        best = (0, 0.0)
        for columns in itertools.permutations(range(wide.shape[1]), wide.shape[0]):
            values = [wide[i, j] for i, j in enumerate(columns) if np.isfinite(wide[i, j])]
            best = max(best, (len(values), -sum(values)))
        pairs = assign(cost)
        assert (len(pairs), -sum(cost[p] for p in pairs)) == best


def test_solvers():
    register_solver("own", shortest_paths)
    assert "own" in available_solvers()
    seen = []
    with default_solver(lambda c: seen.append(1) or shortest_paths(c)):
        assert assign([[1, 1], [1, 2]]) == [(0, 1), (1, 0)]
    assert seen


def heaviest_total(weights, rows, used=frozenset()):
    """The greatest total of any matching, by trying all."""
    if not rows:
        return 0
    taken = [weights[rows[0], j] + heaviest_total(weights, rows[1:], used | {j}) for i, j in weights if i == rows[0] and j not in used]
    return max([heaviest_total(weights, rows[1:], used), *taken])


def test_heaviest_matching():
    """Sparse matchings equal the best of all, with whole weights, ties and fractions."""
    rng = random.Random(1)
    for k in range(600):
        n, m = rng.randrange(1, 6), rng.randrange(1, 6)
        weights = {(rng.randrange(n), rng.randrange(m)): rng.random() if k % 3 == 0 else rng.randrange(1, 5) for _ in range(rng.randrange(1, 15))}
        rows, columns, values = (np.array(x) for x in zip(*[(i, j, w) for (i, j), w in weights.items()], strict=True))
        chosen = heaviest_matching(rows, columns, values)
        assert len(set(rows[chosen])) == len(set(columns[chosen])) == len(chosen)
        assert values[chosen].sum() == pytest.approx(heaviest_total(weights, sorted(set(rows.tolist()))))


def test_heaviest_matching_of_many():
    """One part of 20,000 edges between 4,000 rows and columns, of which a dense matrix would have 16 million cells."""
    rng = np.random.default_rng(2)
    key = np.unique(rng.integers(0, 4000, 20000) * 4000 + rng.integers(0, 4000, 20000))
    chosen = heaviest_matching(key // 4000, key % 4000, rng.integers(1, 50, len(key)))
    assert 3600 < len(chosen) and len(np.unique(key[chosen] // 4000)) == len(chosen) == len(np.unique(key[chosen] % 4000))


def test_heaviest_pairs(spark):
    """Groups solved whole and split into connected parts give the same totals; nulls and weights of 0 take no part."""
    rng = random.Random(4)
    rows = {(f"s{s}", 10 * part + rng.randrange(4), 10 * part + rng.randrange(4)): rng.randrange(0, 6) for s in range(3) for part in range(12) for _ in range(9)}
    edges = spark.createDataFrame([(*k, w) for k, w in rows.items()] + [("s0", None, 5, 9), ("s1", 3, None, 9), (None, 1, 1, 9)], "seq string, a long, b long, n long")
    best = {}
    for s in ("s0", "s1", "s2"):
        for part in range(12):
            own = {(a, b): w for (x, a, b), w in rows.items() if x == s and a // 10 == part and w}
            best[s] = best.get(s, 0) + heaviest_total(own, sorted({a for a, _ in own}))
    for whole in (0, 80, 1000):
        got = heaviest_pairs(edges, ["seq"], "a", "b", "n", whole).collect()
        assert all(rows[r.seq, r.a, r.b] == r.n > 0 for r in got)
        assert len({(r.seq, r.a) for r in got}) == len({(r.seq, r.b) for r in got}) == len(got)
        assert {s: sum(r.n for r in got if r.seq == s) for s in best} == best
    assert heaviest_pairs(edges.limit(0), ["seq"], "a", "b", "n").count() == 0


def test_connected_components(spark):
    """Paths, rings, loops and repeats; one graph a key; strings as nodes; nulls left out."""
    rng = random.Random(6)
    edges = [("x", k, k + 1) for k in range(40)] + [("x", 100, 100), ("x", 5, 5), ("x", 200, 201), ("x", 201, 200), ("y", 3, 90), ("y", None, 3), (None, 7, 8)]
    edges += [("z", rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    low = {}
    for key, u, v in edges:
        if None not in (key, u, v):
            a, b = low.setdefault((key, u), u), low.setdefault((key, v), v)
            low.update({n: min(a, b) for n, x in low.items() if n[0] == key and x in (a, b)})
    df = spark.createDataFrame(rng.sample(edges, len(edges)), "g string, u long, v long").dropna()
    assert {(r.g, r.node): r.component for r in connected_components(df, ("g",)).collect()} == low
    names = df.filter("g = 'z'").select(F.format_string("n%03d", "u").alias("u"), F.format_string("n%03d", "v").alias("v"))
    got = connected_components(names).collect()
    assert {r.node: r.component for r in got} == {f"n{n:03d}": f"n{x:03d}" for (g, n), x in low.items() if g == "z"} and len(got) == len({r.node for r in got})
    assert connected_components(names.limit(0)).count() == 0


SCHEMA = "seq string, frame_id long, oids array<long>, hids array<long>, dists array<array<double>>"


def log(spark, frames, **options):
    return mot_events.event_log(spark.createDataFrame([("a", *f) for f in frames], SCHEMA), **options)


def random_frames(seed, n=40, objects=4, hypotheses=4, near=0.6):
    """Frames with gaps, ids that come and go, and distances that never tie."""
    rng = random.Random(seed)
    out = []
    for frame in sorted(rng.sample(range(2 * n), n)):
        oids = [o for o in range(objects) if rng.random() < 0.7]
        hids = [20 + h for h in range(hypotheses) if rng.random() < 0.7]
        out.append((frame, oids, hids, [[rng.random() if rng.random() < near else None for _ in hids] for _ in oids]))
    return out


def plain_outcomes(frames, max_switch_time=float("inf")):
    """(frame, type, object, hypothesis) of all outcomes, matching by trying every set of pairs."""
    out, partner, owner, known, present = [], {}, {}, set(), {}
    for frame, oids, hids, dists in frames:
        near = {(o, h): dists[i][j] for i, o in enumerate(oids) for j, h in enumerate(hids) if dists[i][j] is not None}
        free_o, free_h = list(oids), list(hids)
        for o in oids:
            if partner.get(o) in free_h and (o, partner[o]) in near:
                out.append((frame, "MATCH", o, partner[o]))
                known.add(partner[o])
                free_o.remove(o)
                free_h.remove(partner[o])
        choices = [[]]
        for o in free_o:
            choices += [[*c, (o, h)] for c in choices for h in free_h if (o, h) in near and h not in {x for _, x in c}]
        for o, h in min(choices, key=lambda c: (-len(c), sum(near[p] for p in c))):
            switched = o in partner and partner[o] != h and frame - present[o] <= max_switch_time
            if switched and h not in known:
                out.append((frame, "ASCEND", o, h))
            if owner.get(h, o) != o:
                out += [(frame, "MIGRATE", o, h)] * (o not in partner) + [(frame, "TRANSFER", o, h)]
            out.append((frame, "SWITCH" if switched else "MATCH", o, h))
            known.add(h)
            partner[o], owner[h] = h, o
            free_o.remove(o)
            free_h.remove(h)
        out += [(frame, "MISS", o, None) for o in free_o] + [(frame, "FP", None, h) for h in free_h]
        present |= dict.fromkeys(oids, frame)
    return out


@pytest.mark.parametrize(("seed", "near", "max_switch_time"), [(1, 0.6, float("inf")), (2, 1.0, float("inf")), (3, 0.4, 2)])
def test_events_and_metrics(spark, seed, near, max_switch_time):
    frames = random_frames(seed, near=near)
    events = log(spark, frames, max_switch_time=max_switch_time)
    want = plain_outcomes(frames, max_switch_time)
    rows = events.orderBy("frame_id", "event").collect()
    assert [(r.frame_id, r.type, r.oid, r.hid) for r in rows if r.type != "RAW"] == want
    raw = {(r.frame_id, r.oid, r.hid): r.d for r in rows if r.type == "RAW" and r.oid is not None and r.hid is not None}
    assert raw == {(f, o, h): d[i][j] for f, oids, hids, d in frames for i, o in enumerate(oids) for j, h in enumerate(hids) if d[i][j] is not None}
    count = lambda *types: sum(t in types for _, t, _, _ in want)
    n_objects, n_hypotheses = (sum(len(f[k]) for f in frames) for k in (1, 2))
    paired = [raw[f, o, h] for f, t, o, h in want if t in ("MATCH", "SWITCH")]
    got = mot_metrics.compute(events, overall=False).first()
    assert (got.num_frames, got.num_objects, got.num_predictions, got.num_detections) == (len(frames), n_objects, n_hypotheses, len(paired))
    names = {"num_matches": "MATCH", "num_switches": "SWITCH", "num_misses": "MISS", "num_false_positives": "FP", "num_transfer": "TRANSFER", "num_ascend": "ASCEND", "num_migrate": "MIGRATE"}
    assert {k: got[k] for k in names} == {k: count(t) for k, t in names.items()}
    assert got.mota == pytest.approx(1 - count("MISS", "FP", "SWITCH") / n_objects) and got.motp == pytest.approx(sum(paired) / len(paired))
    common = {}
    for f, o, h in raw:
        common[o, h] = common.get((o, h), 0) + 1
    assert got.idtp == heaviest_total(common, sorted({o for o, _ in common}))
    assert (got.idfp, got.idfn) == (n_hypotheses - got.idtp, n_objects - got.idtp)
    objects, hypotheses, pairs = mot_metrics.id_counts(events)
    assert {r.oid: r.n for r in objects.collect()} == {o: sum(o in f[1] for f in frames) for o in range(4)}
    assert {r.hid: r.n for r in hypotheses.collect()} == {h: sum(h in f[2] for f in frames) for h in range(20, 24)}
    assert {(r.oid, r.hid): r.n for r in pairs.collect()} == common


def test_one_side_only(spark):
    """Frames without objects, without hypotheses and without either; a rate without a denominator is null."""
    names = ["num_misses", "num_false_positives", "idfn", "idfp", "num_frames", "mota", "precision"]
    for oids, hids in (([], [5, 6, 7]), ([5, 6, 7], []), ([], [])):
        got = mot_metrics.compute(log(spark, [(k, oids, hids, [[None] * len(hids)] * len(oids)) for k in range(0, 10, 2)]), names, overall=False).first()
        assert tuple(got)[1:6] == (5 * len(oids), 5 * len(hids), 5 * len(oids), 5 * len(hids), 5)
        assert got.mota == (0 if oids else None) and got.precision == (0 if hids else None)


def test_auto_id():
    acc = mot_events.Accumulator(auto_id=True)
    assert [acc.update([1], [1], [[0.0]])[0] for _ in range(3)] == [0, 1, 2]
    with pytest.raises(ValueError, match="frame id"):
        acc.update([1], [1], [[0.0]], 9)
    with pytest.raises(ValueError, match="frame id"):
        mot_events.Accumulator().update([1], [1], [[0.0]])


def test_ignored_hypotheses():
    acc = mot_events.Accumulator()
    _, events = acc.update([1], [1, 2], [[0.1, N]], 0, ignore={2})
    assert ("FP", None, 2, None) not in [e[1:] for e in events] and ("RAW", None, 2, None) not in [e[1:] for e in events]


def test_frames_from_boxes(spark):
    """Every frame of either side, with all pairs of points within reach."""
    rng = random.Random(21)
    points = lambda n: [("s", f, i, rng.uniform(0, 6), 0.0) for f in rng.sample(range(12), 8) for i in range(rng.randrange(1, n))]
    a, b = points(4), points(5)
    columns = "seq string, frame_id long, id long, x double, y double"
    one, two = spark.createDataFrame(a, columns), spark.createDataFrame(b, columns)
    frames = mot_events.frames_from_boxes(one, two, boxes.l2_join(one, two, 2).withColumnRenamed("d2", "d"))
    near = {(f, i, j): (x - y) ** 2 for _, f, i, x, _ in a for _, g, j, y, _ in b if f == g and (x - y) ** 2 <= 2}
    got = {r.frame_id: r for r in frames.collect()}
    assert set(got) == {p[1] for p in a + b}
    for f, r in got.items():
        assert list(r.oids) == sorted(p[2] for p in a if p[1] == f) and list(r.hids) == sorted(p[2] for p in b if p[1] == f)
        assert [[None if d is None else pytest.approx(d) for d in row] for row in r.dists] == [[near.get((f, i, j)) for j in r.hids] for i in r.oids]


def test_registry(spark):
    assert mot_metrics.registry.needed(["mota"])[-1] == "mota" and "idtp" not in mot_metrics.registry.needed(["mota"])
    assert mot_metrics.registry.table(spark).count() == len(mot_metrics.registry.metrics)
    assert "|MOTA|" not in mot_metrics.registry.markdown()
    frames = [(0, [1, 2], [7], [[0.5], [None]]), (1, [1, 2], [7], [[0.5], [None]])]
    shown = mot_metrics.rendered(mot_metrics.compute(log(spark, frames), ["mota", "num_misses"])).first()
    assert shown.MOTA == "50.0%" and shown.FN == "2"


def best_by_permutation(score):
    """The pairs of the matching with the greatest total, by trying all; absent pairs score 0."""
    gs, ds = sorted({k[0] for k in score}), sorted({k[1] for k in score})
    ds += [None] * len(gs)
    best = max(itertools.permutations(ds, len(gs)), key=lambda p: sum(score.get((g, d), 0) for g, d in zip(gs, p, strict=True)))
    return [(g, d) for g, d in zip(gs, best, strict=True) if score.get((g, d), 0) > 0]


def plain_hota(pairs, gt, tr):
    """HOTA by loops: (tp, assa, loca, fraga) for each threshold."""
    sims = {}
    for _, t, g, d, s in pairs:
        sims.setdefault(t, {})[g, d] = s
    gc, tc, potential = {}, {}, {}
    for _, _, g in gt:
        gc[g] = gc.get(g, 0) + 1
    for _, _, d in tr:
        tc[d] = tc.get(d, 0) + 1
    for frame in sims.values():
        for (g, d), s in frame.items():
            r = sum(v for (a, _), v in frame.items() if a == g)
            c = sum(v for (_, b), v in frame.items() if b == d)
            potential[g, d] = potential.get((g, d), 0) + s / (r + c - s)
    align = {k: p / (gc[k[0]] + tc[k[1]] - p) for k, p in potential.items()}
    matched = []
    for t in sorted(sims):
        score = {k: align[k] * s for k, s in sims[t].items()}
        matched += [(t, g, d, sims[t][g, d]) for g, d in best_by_permutation(score)]
    out = []
    for alpha in hota.ALPHAS:
        own = [m for m in matched if m[3] >= alpha - hota.EPS]
        count, runs, last = {}, {}, {}
        for _, g, d, _ in own:
            count[g, d] = count.get((g, d), 0) + 1
            if last.get(g) != d:
                runs.setdefault((g, d), []).append(0)
            runs[g, d][-1] += 1
            last[g] = d
        n = max(1, len(own))
        either = {k: gc[k[0]] + tc[k[1]] - m for k, m in count.items()}
        out.append((len(own), sum(m * m / either[k] for k, m in count.items()) / n, max(1e-10, sum(m[3] for m in own)) / max(1e-10, len(own)), sum(sum(r * r for r in runs[k]) / either[k] for k in runs) / n))
    return out


@pytest.mark.parametrize(("seed", "share"), [(3, 1), (4, 0.5)])
def test_hota(spark, seed, share):
    rng = random.Random(seed)
    gt = [("s", t, g) for t in range(12) for g in range(4) if rng.random() < 0.8]
    tr = [("s", t, d) for t in range(12) for d in range(5) if rng.random() < 0.7]
    pairs = [("s", t, g, d, rng.random()) for _, t, g in gt for _, u, d in tr if t == u and rng.random() < share]
    got = hota.evaluate(spark.createDataFrame(pairs, "seq string, t long, gt_id long, tr_id long, sim double"), spark.createDataFrame(gt, "seq string, t long, id long"), spark.createDataFrame(tr, "seq string, t long, id long")).orderBy("alpha").collect()
    for row, (tp, assa, loca, fraga) in zip(got, plain_hota(pairs, gt, tr), strict=True):
        assert row.hota_tp == tp and row.hota_fn == len(gt) - tp and row.hota_fp == len(tr) - tp
        assert row.assa == pytest.approx(assa) and row.loca == pytest.approx(loca) and row.fraga == pytest.approx(fraga)
        assert 0 <= row.hota <= 1


def test_hota_matchings_prefer_score_to_pairs(spark):
    """One good pair is better than two poor ones, in each kind of matching."""
    ids = spark.createDataFrame([("s", 0, 1), ("s", 0, 2)], "seq string, t long, id long")
    pairs = spark.createDataFrame([("s", 0, 1, 1, 0.9), ("s", 0, 1, 2, 0.1), ("s", 0, 2, 1, 0.1)], "seq string, t long, gt_id long, tr_id long, sim double")
    for matching in ("aligned", "similarity", "per_alpha"):
        tp = {r.alpha: r.hota_tp for r in hota.evaluate(pairs, ids, ids, matching=matching).collect()}
        assert tp[0.5] == 1 and tp[0.9] == 1 and tp[0.95] == 0
        assert tp[0.05] == (2 if matching == "per_alpha" else 1)
    with pytest.raises(ValueError, match="unknown matching"):
        hota.evaluate(pairs, ids, ids, matching="x")


def test_hota_one_side(spark):
    schema = "seq string, t long, id long"
    gt, none = spark.createDataFrame([("s", 0, 1), ("s", 1, 1)], schema), spark.createDataFrame([], schema)
    pairs = spark.createDataFrame([], "seq string, t long, gt_id long, tr_id long, sim double")
    for a, b, want in ((gt, none, (0, 2, 0)), (none, gt, (0, 0, 2))):
        rows = hota.evaluate(pairs, a, b).collect()
        assert len(rows) == 19 and all((r.hota_tp, r.hota_fn, r.hota_fp, r.loca) == (*want, 1.0) for r in rows)


def test_assign_groups_any_partitions(spark):
    rng = random.Random(8)
    rows = [(g, i, j, rng.random()) for g in range(50) for i in range(4) for j in range(5) if rng.random() < 0.6]
    edges = spark.createDataFrame(rows, "g long, i long, j long, c double")
    one, many = (sorted(map(tuple, assign_groups(edges.repartition(n), ["g"], "i", "j", "c").collect())) for n in (1, 7))
    assert one == many


def test_tracker():
    t = tracker.Tracker(min_affinity=0.5, patience=2)
    assert t.step(0, [1, 2], {}, {}) == [(1, 0), (2, 1)]
    assert t.step(1, [3, 4], {(1, 4): 0.9, (2, 3): 0.8, (1, 3): 0.7}, {}) == [(3, 1), (4, 0)]
    t = tracker.Tracker(min_affinity=0.5)
    t.step(0, [1], {}, {})
    assert t.step(1, [3, 4], {(1, 3): 0.7, (1, 4): 0.9}, {}) == [(3, 0), (4, 1)]
    t = tracker.Tracker(min_similarity=0.5, patience=3)
    t.step(0, [1], {}, {1: [1.0, 0.0]})
    t.step(1, [], {}, {})
    assert t.step(2, [2], {}, {2: [0.9, 0.1]}) == [(2, 0)]
    t = tracker.Tracker(patience=1, reid=False)
    t.step(0, [1], {}, {1: [1.0, 0.0]})
    t.step(1, [], {}, {})
    assert t.step(2, [2], {}, {2: [1.0, 0.0]}) == [(2, 1)]


def test_fused_affinity(spark):
    rows = [
        ("s", 0, 1, 1, 0.9, 0.9, 4.0, 8),  # chosen: 0.9 + 0.5
        ("s", 0, 1, 2, 0.5, 0.9, 3.9, 8),  # nearly as good, no track of its own
        ("s", 0, 1, 3, 0.05, 0.99, 4.0, 8),  # box too small: no value, a ratio by correlation alone
        ("s", 0, 2, 1, 0.9, 0.85, 4.0, 8),  # a second track for detection 1
        ("s", 0, 3, 3, 0.9, 0.7, 9.0, 1),  # most value, but the pose is too far
        ("s", 1, 1, 1, None, None, None, 0),
    ]
    pairs = spark.createDataFrame(rows, "seq string, frame_id long, track_id long, det_id long, box double, pose double, corr double, n_joints int")
    scored = tracker.fused_affinity(pairs)
    chosen = {(r.track_id, r.det_id): (round(r.value, 9), r.votes) for r in scored.filter("chosen").collect()}
    assert chosen == {(1, 1): (1.4, 3), (2, 1): (1.35, 3)}
    assert [(r.det_id, r.track_id) for r in tracker.associated(scored).collect()] == [(1, 1)]
    found = lambda least: sorted((r.det_id, r.track_id) for r in tracker.duplicates(scored, least).collect())
    assert found(1.5) == [(2, 1)]
    assert found(0.99) == [(2, 1), (3, 1)]
    assert found(1.98) == []


def test_assignment_solver_reaches_tasks(spark):
    edges = spark.createDataFrame([(0, i, j, float(i == j)) for i in range(3) for j in range(3)], "g long, i long, j long, c double")
    pairs = lambda **more: sorted((r.i, r.j) for r in assign_groups(edges, ["g"], "i", "j", "c", **more).collect())
    assert pairs(solver=lambda cost: np.arange(len(cost))) == [(0, 0), (1, 1), (2, 2)]
    assert all(i != j for i, j in pairs())


def plain_log(frames, **options):
    """One fold over the whole sequence."""
    acc, out = mot_events.Accumulator(**options), []
    for frame, oids, hids, dists in sorted(frames, key=lambda f: f[0]):
        _, events = acc.update(oids, hids, mot_events.matrix(dists, len(oids), len(hids)), frame)
        out += [(frame, *e) for e in events]
    return out


@pytest.mark.parametrize("max_switch_time", [float("inf"), 6])
def test_segments_equal_one_fold(spark, max_switch_time):
    """A sequence in several segments: gaps, long absences, ties, swaps that last over many segments, and frames without anything."""
    rng = random.Random(12)
    sequences = {}
    for s in range(4):
        frames = []
        for frame in sorted(rng.sample(range(160), 110)):
            oids = [o for o in range(5) if rng.random() < (0.9 if o < 2 else 0.3)]
            hids = [10 + h for h in range(5) if rng.random() < (0.95 if h < 2 else 0.4)]
            near = 0.9 if s == 0 else 0.35  # where all is near, matches are carried on through all segments
            frames.append((frame, oids, hids, [[rng.choice((0.25, 0.5, 0.75, rng.random())) if rng.random() < near else None for _ in hids] for _ in oids]))
        sequences[f"s{s}"] = frames
    df = spark.createDataFrame([(s, *f) for s, frames in sequences.items() for f in frames], SCHEMA).repartition(5)
    for segment in (5, 40, 20_000):
        rows = mot_events.event_log(df, max_switch_time, segment=segment).collect()
        for s, frames in sequences.items():
            got = sorted((r.frame_id, r.event, r.type, r.oid, r.hid, r.d) for r in rows if r.seq == s)
            assert [tuple(r) for r in got] == [tuple(r) for r in plain_log(frames, max_switch_time=max_switch_time)]
    numbered = mot_events.event_log(df, max_switch_time, auto_id=True, segment=9).filter("seq = 's1'").agg(F.max("frame_id")).first()[0]
    assert numbered == len(sequences["s1"]) - 1
    assert mot_events.event_log(df.limit(0)).count() == 0
