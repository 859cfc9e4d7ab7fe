import itertools
import random
import time

import numpy as np
import pytest

from tracklake.operators import detection_metrics, matching, mota
from tracklake.operators.assignment import maximum_assignment, minimum_assignment

BOX = "video string, frame int, {id} int, x1 double, y1 double, x2 double, y2 double"
N = None

#: Previous and current frame as true id to predicted id (none: missed), and the switches. Fixed values.
SWITCHES = [
    ({}, {1: 11, 2: 12, 3: 13, 4: 14}, 0),
    ({1: 11, 2: 12, 3: 13, 4: 14}, {1: 11, 2: 12, 3: 13, 4: 14}, 0),
    ({1: 11, 2: 12, 3: 13, 4: 14}, {1: 11, 2: 12, 3: N, 4: 14}, 0),
    ({1: 11, 2: 12, 3: N, 4: 14}, {1: 11, 2: 12, 3: 13, 4: 14}, 0),
    ({1: 11, 2: 12, 3: 13, 4: 14}, {1: 11, 2: 12, 3: 15, 4: 14}, 1),
    ({1: 11, 2: 12, 3: 13, 4: 14}, {1: 11, 2: 12, 3: 14}, 2),
    ({1: 11, 2: 12, 3: 13}, {1: 11, 2: 12, 3: 99, 5: 13}, 2),
    ({1: 11, 2: 12, 3: 13}, {1: 11, 2: 12, 3: 99, 4: 14}, 1),
    ({1: 11, 2: 12, 3: 13}, {1: 11, 2: 12, 3: 99, 4: 13}, 3),
    ({1: 11, 2: 12, 3: 13, 4: 14}, {1: 11, 2: 12, 3: 14, 4: 13}, 4),
    ({1: 11, 2: 12, 3: 13, 4: 14}, {1: 11, 2: 12, 3: 13}, 0),
    ({1: 11, 2: 12, 3: 13, 4: 14}, {1: 11, 2: 12, 3: 14}, 2),
    ({1: 11, 2: 12, 3: 13, 4: 14}, {1: 11, 2: 12, 3: 13, 5: 14}, 1),
    ({1: 11, 2: 12, 3: 13, 4: N}, {1: 11, 2: 12, 3: 13}, 0),
    ({1: 11, 2: 12, 3: 13, 4: N}, {1: 11, 2: 12, 3: 13, 5: N}, 0),
    ({1: 11, 2: 12, 3: 13, 4: N}, {1: 11, 2: 12, 3: N}, 0),
    ({1: 11, 2: 12, 3: 13}, {1: 11, 2: 12, 5: 13}, 1),
    ({1: 11, 2: 12, 3: 13}, {1: 11, 2: 12, 3: 13, 5: 15}, 0),
    ({1: 11, 2: 12, 3: 13}, {1: 11, 2: 12, 3: 15, 5: 13}, 2),
    ({1: 11, 2: 12, 3: 13}, {1: 11, 2: 12, 5: 13}, 1),
    ({1: 11, 2: 12, 3: 13}, {1: 11, 2: 12, 3: 13, 5: N}, 0),
    ({1: 11, 2: 12, 3: 13, 4: N}, {1: 11, 2: 12, 3: 13, 5: N}, 0),
    ({1: 11, 2: 12, 3: N}, {1: 11, 2: 12, 3: 13, 5: N}, 0),
    ({1: 11, 2: 12, 3: N}, {1: 11, 2: 12, 3: 13}, 0),
    ({1: 11, 2: 12, 3: N}, {1: 11, 2: 12, 3: 14}, 1),
    ({1: 11, 2: 12}, {1: 11, 2: 12, 3: 13}, 0),
    ({1: 11, 2: 12}, {1: 11, 2: 12, 3: 14}, 1),
    ({1: 11, 2: 12, 3: 13, 5: N}, {1: 11, 2: 12, 3: N, 5: 13}, 1),
]
HISTORY = {1: 11, 2: 12, 3: 13, 4: 14}


@pytest.mark.parametrize("stretch", [4096, 7])
def test_identity_switches(spark, stretch):
    rows = []
    for case, (before, now, _) in enumerate(SWITCHES):
        # the history lies before the previous frame, one frame for each id, so that it makes no swaps
        if before:
            rows += [(case, i * 2, g, p) for i, (g, p) in enumerate(HISTORY.items())] + [(case, 90, 77, None)]
            rows += [(case, 100, g, p) for g, p in before.items()]
        rows += [(case, 101, g, p) for g, p in now.items()]
    df = spark.createDataFrame(rows, "video int, frame int, gt_id int, pred_id int")
    got = {r.video: r.n for r in mota.identity_switches(df, ["video"], stretch).filter("frame = 101").groupBy("video").agg({"reid": "sum", "swap": "sum"}).selectExpr("video", "`sum(reid)` + `sum(swap)` n").collect()}
    assert [got[i] for i in range(len(SWITCHES))] == [w for _, _, w in SWITCHES]


def scene(spark, truth, preds):
    t = spark.createDataFrame([("v", f, i, *map(float, b)) for f, i, b in truth], BOX.format(id="gt_id"))
    p = spark.createDataFrame([("v", f, i, *map(float, b), 0.9) for f, i, b in preds], BOX.format(id="pred_id") + ", score double")
    return t, p


A, B, D = (10, 10, 20, 20), (30, 30, 40, 40), (70, 70, 80, 80)



def plain_accuracy(truth, preds, threshold):
    """Frame by frame: predictions in order take their best free box; what was last seen of each id is kept in dictionaries."""
    known, owners, out = {}, {}, {}
    for f in sorted({f for f, *_ in truth} & {f for f, *_ in preds}):
        true, shown = {i: b for g, i, b in truth if g == f}, {i: b for g, i, b in preds if g == f}
        taken = {}
        for p, box in sorted(shown.items()):
            free = [(inclusive(b, box), -g) for g, b in true.items() if g not in taken and inclusive(b, box) > threshold]
            if free:
                taken[-max(free)[1]] = p
        switches = sum(g in known and known[g] != p for g, p in taken.items()) + sum(owners.get(p, g) != g for g, p in taken.items())
        known |= taken
        owners = {p: g for g, p in taken.items()}
        missed, wrong = len(true) - len(taken), len(shown) - len(taken)
        out[f] = (len(true), len(taken), missed, wrong, switches, round(1 - (missed + wrong + switches) / len(true), 9))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_accuracy_equals_a_plain_loop(spark, seed):
    """Boxes that wander through a small room, with predictions that are lost, doubled and exchanged."""
    rng = random.Random(seed)
    truth, preds = [], []
    at = {g: [rng.randrange(40), rng.randrange(40)] for g in range(1, 7)}
    names = {g: 10 + g for g in at}
    for f in range(25):
        if rng.random() < 0.3:
            a, b = rng.sample(sorted(at), 2)
            names[a], names[b] = names[b], names[a]
        for g, c in at.items():
            c[0], c[1] = c[0] + rng.randrange(-3, 4), c[1] + rng.randrange(-3, 4)
            if rng.random() < 0.9:
                truth.append((f, g, (c[0], c[1], c[0] + 15, c[1] + 12)))
            if rng.random() < 0.8:
                x, y = c[0] + rng.randrange(-4, 5), c[1] + rng.randrange(-4, 5)
                preds.append((f, names[g], (x, y, x + 15, y + 12)))
            if rng.random() < 0.1:
                preds.append((f, 50 + f * 7 + g, (c[0] + 2, c[1], c[0] + 19, c[1] + 12)))
    t, p = scene(spark, truth, preds)
    rows = mota.mota_per_frame(t, p, ["video"], 0.2, stretch=(4096, 4, 1)[seed - 1]).collect()
    got = {r.frame: (r.total_ground_truth, r.true_positives, r.missed_detections, r.false_positives, r.switches, round(r.mota, 9)) for r in rows}
    assert got == plain_accuracy(truth, preds, 0.2)
    assert sum(x[4] for x in got.values()) > 5


def test_accuracy_over_frames(spark):
    truth = [(f, i + 1, b) for f in (333, 334, 335) for i, b in enumerate((A, B))]
    preds = [(333, 1, A), (333, 9, D), (334, 1, A), (334, 2, B), (335, 2, A), (335, 1, B)]
    t, p = scene(spark, truth, preds)
    rows = mota.mota_per_frame(t, p, ["video"], 0.1).orderBy("frame").collect()
    assert [r.true_positives for r in rows] == [1, 2, 2] and [r.missed_detections for r in rows] == [1, 0, 0] and [r.false_positives for r in rows] == [1, 0, 0]
    assert [r.switches for r in rows] == [0, 0, 4] and [r.mota for r in rows] == [0, 1, -1] and [r.frame_index for r in rows] == [0, 1, 2]
    all_ = mota.mota_overall(mota.mota_per_frame(t, p, ["video"], 0.1)).first()
    assert all_.mean_mota == 0 and all_.aggregated_mota == 0


def test_frames_without_predictions(spark):
    t, p = scene(spark, [(1, 1, A), (2, 1, A), (3, 1, A)], [(1, 5, A), (9, 5, A)])
    assert [r.frame for r in mota.mota_per_frame(t, p, ["video"]).collect()] == [1]
    shown = spark.createDataFrame([("v", 1), ("v", 3)], "video string, frame int")
    got = mota.mota_per_frame(t, p, ["video"], predicted_frames=shown).orderBy("frame").collect()
    assert [(r.frame, r.missed_detections) for r in got] == [(1, 0), (3, 1)]


def inclusive(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0]) + 1), max(0, min(a[3], b[3]) - max(a[1], b[1]) + 1)
    s = lambda x: (x[2] - x[0] + 1) * (x[3] - x[1] + 1)
    return w * h / (s(a) + s(b) - w * h)


def crowd(seed):
    rng = random.Random(seed)

    def boxes(n):
        for _ in range(n):
            x, y = rng.randrange(40), rng.randrange(40)
            yield (x, y, x + rng.randrange(5, 25), y + rng.randrange(5, 25))

    return [(f, i, b) for f in range(15) for i, b in enumerate(boxes(rng.randrange(1, 9)))], [(f, i, b) for f in range(15) for i, b in enumerate(boxes(rng.randrange(0, 9)))]


def test_greedy_match_equals_a_loop(spark):
    truth, preds = crowd(4)
    t, p = scene(spark, truth, preds)
    got = {(r.frame, r.gt_id, r.pred_id) for r in matching.greedy_match(matching.box_pairs(t, p, ["video"], 0.1, inclusive=True), ["video"]).collect()}
    want = set()
    for f in range(15):
        free = [(i, b) for g, i, b in truth if g == f]
        for _, j, b in sorted(x for x in preds if x[0] == f):
            best, which = 0.1, None
            for i, c in free:
                if inclusive(c, b) > best:
                    best, which = inclusive(c, b), i
            if which is not None:
                want.add((f, which, j))
                free = [x for x in free if x[0] != which]
    assert got == want


def test_grid_join_equals_plain_join(spark):
    t, p = scene(spark, *crowd(5))
    key = ["frame", "gt_id", "pred_id"]
    plain = sorted(map(tuple, matching.box_pairs(t, p, ["video"], 0.05).select(*key).collect()))
    assert plain == sorted(map(tuple, matching.grid_pairs(t, p, ["video"], 8.0, 0.05).select(*key).collect()))


def test_assignment_equals_enumeration():
    rng = np.random.RandomState(3)
    for n, m in itertools.product(range(1, 6), repeat=2):
        for cost in (rng.rand(n, m), rng.randint(0, 3, (n, m)).astype(float)):
            pairs = minimum_assignment(cost)
            small, large = min(n, m), max(n, m)
            best = min(sum(cost[i, j] if n <= m else cost[j, i] for i, j in enumerate(q)) for q in itertools.permutations(range(large), small))
            assert len(pairs) == small == len(set(pairs[:, 0])) == len(set(pairs[:, 1]))
            assert np.isclose(cost[pairs[:, 0], pairs[:, 1]].sum(), best)
    assert maximum_assignment(np.zeros((0, 3))).shape == (0, 2)


def test_optimal_match_and_metrics(spark):
    t, p = scene(spark, [(1, 1, A), (1, 2, B), (1, 3, (50, 50, 60, 60))], [(1, 7, A), (1, 8, (200, 200, 210, 210))])
    r = detection_metrics.confusion(t, p, ["video"], 0.5).first()
    assert (r.tp, r.fp, r.fn) == (1, 1, 2) and r.precision == 0.5 and round(r.recall, 6) == round(1 / 3, 6)
    truth, preds = crowd(6)
    t, p = scene(spark, truth, preds)
    got = matching.optimal_match(matching.box_pairs(t, p, ["video"]), ["video"], -1.0).groupBy("frame").agg({"iou": "sum"}).collect()
    apart = matching.optimal_match(matching.box_pairs(t, p, ["video"]), ["video"], -1.0, cells=0).groupBy("frame").agg({"iou": "sum"}).collect()
    assert {r.frame: round(r[1], 9) for r in apart} == {r.frame: round(r[1], 9) for r in got}
    from tracklake.operators.tracker import overlaps

    for f, total in got:
        a, b = np.array([x for g, _, x in truth if g == f], float), np.array([x for g, _, x in preds if g == f], float)
        gain = overlaps(a, b)
        pair = maximum_assignment(gain)
        assert np.isclose(total, gain[pair[:, 0], pair[:, 1]].sum())


@pytest.mark.parametrize("tp, fp, fn, want", [(10, 2, 1, (10 / 12, 10 / 11)), (0, 0, 0, (0, 0))])
def test_precision_and_recall(spark, tp, fp, fn, want):
    df = spark.createDataFrame([(tp, fp, fn)], "tp long, fp long, fn long")
    r = df.select(detection_metrics.ratio("tp", "fp").alias("p"), detection_metrics.ratio("tp", "fn").alias("r")).first()
    assert (round(r.p, 9), round(r.r, 9)) == (round(want[0], 9), round(want[1], 9))


@pytest.mark.parametrize("threshold, n", [(0.5, 3), (0.83, 2), (0.95, 0)])
def test_scores_above_threshold(spark, threshold, n):
    df = spark.createDataFrame([(0.9,), (0.85,), (0.8,)], "score double")
    assert matching.above_score(df, threshold).count() == n


def test_a_crowd_is_solved_cluster_by_cluster(spark, monkeypatch):
    """5,000 true boxes of one frame in clusters of three, each with a best sum that no greedy match finds."""
    rng = random.Random(8)
    truth, preds = [], []
    for c in range(1667):
        x, y = 100 * (c % 50), 100 * (c // 50)
        for i in range(3):
            truth.append((0, 3 * c + i, (x + 12 * i, y, x + 12 * i + 30, y + 20)))
            preds.append((0, 3 * c + i, (x + 12 * i + rng.randrange(-5, 6), y, x + 12 * i + 30, y + 20)))
    t, p = scene(spark, truth, preds)
    pairs = matching.grid_pairs(t, p, ["video"])
    links = {}
    for r in pairs.collect():
        links.setdefault(r.gt_id // 3, {})[r.gt_id % 3, r.pred_id % 3] = r.iou
        assert r.gt_id // 3 == r.pred_id // 3
    best = sum(max(sum(k.get((g, o[g]), 0.0) for g in range(3)) for o in itertools.permutations(range(3))) for k in links.values())
    assert len(truth) ** 2 > 1000 * matching.CELLS
    found = matching.optimal_match(pairs, ["video"]).collect()
    assert abs(sum(r.iou for r in found) - best) < 1e-6 and len({r.gt_id for r in found}) == len({r.pred_id for r in found}) == len(found)


def test_clusters_share_no_box():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (40, 30), (300, 200), (2000, 1999)):
        left, right = (rng.integers(0, n, m), rng.integers(0, n, m)) if n != 2000 else (np.r_[np.arange(1999)], np.r_[0, np.arange(1998)])
        _, left = np.unique(left, return_inverse=True)
        _, right = np.unique(right, return_inverse=True)
        found = matching.clusters(left, right)
        groups = [({int(x) for x in left[found == c]}, {int(x) for x in right[found == c]}) for c in np.unique(found)]
        assert sum(len(g) for g, _ in groups) == len(np.unique(left)) and sum(len(r) for _, r in groups) == len(np.unique(right))
        for g, r in groups:  # each is connected
            reach, seen = {min(g)}, set()
            while reach - seen:
                at = (reach - seen).pop()
                seen.add(at)
                reach |= {int(x) for x in left[np.isin(right, right[left == at])]}
            assert reach == g


def test_boxes_of_any_size_meet_in_cells(spark):
    """Boxes of a large frame meet in cells; very wide, turned, empty and endless ones meet all of those they overlap."""
    rng = random.Random(3)
    some = lambda n, size: [(x := rng.uniform(-3000, 3000), y := rng.uniform(-3000, 3000), x + rng.uniform(0, size), y + rng.uniform(0, size)) for _ in range(n)]
    odd = [(-1e12, 0.0, 1e12, 50.0), (0.0, 0.0, float("inf"), 40.0), (float("nan"), 0.0, 5.0, 5.0), (90.0, 90.0, 10.0, 10.0)]
    truth = [(0, i, b) for i, b in enumerate([*some(150, 300), *some(20, 5000), *odd])]
    preds = [(0, i, b) for i, b in enumerate([*some(150, 300), *some(20, 5000), *odd])]
    t, p = scene(spark, truth, preds)
    for inclusive in (False, True):
        every = matching.box_pairs(t, p, ["video"], -2.0, inclusive).filter("iou > 0.01").select("gt_id", "pred_id", "iou")
        got = matching.box_pairs(t, p, ["video"], 0.01, inclusive).select("gt_id", "pred_id", "iou")
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, every.collect()))) and got.count() > 100
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "gx" in plan


def test_greedy_match_and_assignment_grow_with_their_links(spark):
    """A chain of 20,000 links in one frame: folding it in one row, or a matrix of it, would take minutes."""
    n = 10000
    truth = [(0, i, (100.0 * i, 0.0, 100.0 * i + 40, 30.0)) for i in range(n)]
    preds = [(0, i, (100.0 * i + 1 + d, 0.0, 100.0 * i + 41 + d, 30.0)) for i in range(n) for d in (0, 7)]
    preds = [(f, j, b) for j, (f, _, b) in enumerate(preds)]
    t, p = scene(spark, truth, preds)
    began = time.time()
    pairs = matching.box_pairs(t, p, ["video"], 0.1)
    assert matching.greedy_match(pairs, ["video"]).filter("pred_id = 2 * gt_id").count() == n
    assert matching.optimal_match(pairs, ["video"]).filter("pred_id = 2 * gt_id").count() == n
    assert time.time() - began < 60


def test_chosen_links_equal_the_best_of_all_ways():
    from tracklake.operators.assignment import chosen_links

    rng = np.random.default_rng(4)
    for n, m, share in ((1, 6, 1.0), (5, 5, 0.6), (7, 3, 0.7), (9, 9, 0.5), (60, 50, 0.02)):
        for _ in range(20):
            gain = np.where(rng.random((n, m)) < share, rng.random((n, m)) + 0.01, 0)
            left, right = np.nonzero(gain)
            if not len(left):
                continue
            (_, left_), (_, right_) = np.unique(left, return_inverse=True), np.unique(right, return_inverse=True)
            kept = chosen_links(left, right, gain[left, right], matching.clusters(left_, right_))
            assert len(set(left[kept])) == kept.sum() == len(set(right[kept]))
            pairs = maximum_assignment(gain)
            assert np.isclose(gain[left[kept], right[kept]].sum(), gain[pairs[:, 0], pairs[:, 1]].sum())
