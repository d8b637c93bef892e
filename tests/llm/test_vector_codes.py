import numpy as np
import pytest

from tickwright.llm import vector_codes as m


def nearest(points, entries):
    return ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)  # the first of equal ones


CASES = {
    "normal": lambda r: (r.normal(0, 32, (3000, 4)).astype(np.int64), 64),
    "clusters": lambda r: ((r.integers(0, 6, (2000, 1)) * 100 + r.integers(-3, 4, (2000, 4))).astype(np.int64), 50),
    "ties": lambda r: (r.integers(-2, 3, (1500, 3)), 64),
    "equal": lambda r: (np.full((400, 4), 7), 9),
    "one": lambda r: (r.integers(-5, 5, (1, 2)), 1),
    "few": lambda r: (r.integers(-50, 50, (37, 5)), 3),
    "large": lambda r: (r.integers(-(1 << 26), 1 << 26, (500, 8)), 64),
    "line": lambda r: (r.integers(0, 1000, (800, 1)), 33),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("seed", range(3))
def test_assignment_equals_all_distances(case, seed):
    rng = np.random.default_rng(seed)
    points, k = CASES[case](rng)
    entries = points[rng.integers(0, len(points), k)] + rng.integers(-1, 2, (k, points.shape[1]))
    tree = m.Halves(points, m.LEAF)
    label, counts, sums, compared = m.assign(tree, entries)
    want = nearest(points, entries)
    assert (label == want[tree.order]).all() and (tree.points == points[tree.order]).all()
    assert (counts == np.bincount(want, minlength=k)).all()
    total = np.zeros_like(entries)
    np.add.at(total, want, points)
    assert (sums == total).all() and compared <= len(points)
    if case == "equal":
        assert compared == 0  # one box, assigned whole


def test_nodes_are_assigned_whole():
    rng = np.random.default_rng(1)
    points = (rng.integers(0, 20, (20000, 1)) * 1000 + rng.integers(-5, 6, (20000, 2))).astype(np.int64)
    assert m.assign(m.Halves(points, m.LEAF), points[:64])[3] < 20000


def brute(rows, parts=16, entries=64, rounds=2):
    """rows: (id, vector, label), in order of id."""
    x = np.array([[int(np.floor(256 * float(v))) for v in r[1]] for r in rows], np.int64)
    width = x.shape[1] // parts
    books = x[:entries].reshape(-1, parts, width).swapaxes(0, 1).copy()
    cut = [x[:, p * width : (p + 1) * width] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            label = nearest(cut[p], books[p])
            for e in set(label.tolist()):
                books[p, e] = np.floor_divide(cut[p][label == e].sum(0), (label == e).sum())
    labels = [nearest(cut[p], books[p]) for p in range(parts)]
    error = sum(((cut[p] - books[p][labels[p]]) ** 2).sum(1) for p in range(parts))
    codes = ["".join(f"{labels[p][i]:02x}" for p in range(parts)) for i in range(len(rows))]
    by_label = {}
    for r, e in zip(rows, error.tolist()):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return [(r[0], c, e, by_label[r[2]]) for r, c, e in zip(rows, codes, error.tolist())], books


def check(spark, rows, want_rows, schema="vec_id bigint, embedding array<float>, label int, code string", **more):
    out, books = m.compress(spark.createDataFrame(rows, schema).repartition(3), **more)
    got = sorted(((r["id"], r["code"], r["error"], r["label_error"]) for r in out.collect()), key=repr)
    want, want_books = brute(want_rows, **{k: v for k, v in more.items() if k != "labels_sent"})
    assert got == sorted(want, key=repr) and (books == want_books).all()


def test_equals_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(0, 0.2, 32).astype(np.float32).tolist(), int(rng.integers(0, 3)) if i % 5 else None, "c") for i in range(-20, 300)]
    good += [(1000 + i, good[7][1], 1, "c") for i in range(150)] + [(1000, good[7][1], 1, "c"), (None, good[3][1], 2, None)]
    nan, inf = float("nan"), float("inf")
    bad = [(-100, None, 1, ""), (-99, [], 1, ""), (-98, [0.5] * 31 + [None], 1, ""), (-97, [nan] * 32, 1, ""), (-96, [0.1] * 31 + [-inf], 2, ""), (5000, [0.1] * 16, 1, ""), (-95, [0.1] * 30, 1, ""), (-94, [1e30] * 32, 2, "")]
    check(spark, good + bad, good)
    check(spark, good + bad, good, labels_sent=0)
    check(spark, good, good, parts=4, entries=7, rounds=3)


def test_few_and_no_rows(spark):
    check(spark, [(3, [0.25] * 16, None, "")], [(3, [0.25] * 16, None, "")])
    for rows in ([], [(1, None, 2, "x")]):
        out, books = m.compress(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, code string"))
        assert out.collect() == [] and books.size == 0
        assert out.columns == ["id", "label", "code", "error", "label_error"]


def test_blocks_of_any_size(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(m, "BLOCK_NUMBERS", 4 * 20)
    flat = np.arange(4 * 70, dtype=np.float32) / 256
    batch = pa.RecordBatch.from_arrays([pa.array(range(70)), pa.ListArray.from_arrays(pa.array(np.arange(71) * 4, pa.int32()), pa.array(flat))], ["id", "vector"])
    got = list(m.blocks([batch.slice(0, 33), batch.slice(33, 2), batch.slice(35)], 4))
    assert np.concatenate([x for _, x in got]).ravel().tolist() == list(range(280))
    assert [i for t, _ in got for i in t.column("id").to_pylist()] == list(range(70)) and max(len(x) for _, x in got) < 40
