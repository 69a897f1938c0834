"""Scores ruled out in single precision, searches that keep their rounds and shortlists in the task, memory of the kernels."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from quiver.operators import coded, encode, index, ivf, knn, pairs, tiles
from tests.test_cells_tiles import drawn, rows_of


def peak_mb(work) -> float:
    tracemalloc.start()
    work()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


def odd_vectors(draw, n, kind, d=6):
    """Zero vectors, many exact copies, and scores that tie (coarse) or differ by many orders of magnitude (far)."""
    X = draw.integers(-2, 3, (n, d)).astype(float) if kind == "coarse" else draw.normal(size=(n, d))
    if kind == "far":
        X *= 10.0 ** draw.integers(-4, 5, (n, 1))
    X[::17], X[1::3] = 0.0, X[1]
    return X


@pytest.mark.parametrize("kind", ["plain", "coarse", "far"])
@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_screened_scores_equal_all_scores(kind, metric):
    draw = np.random.default_rng(1)
    Q, C = odd_vectors(draw, 600, kind), odd_vectors(draw, 4500, kind)
    qids, docs = np.arange(600), draw.permutation(9000)[:4500]
    label, other = draw.integers(0, 3, 600), draw.integers(0, 3, 4500)
    K = knn._keys(Q, C, metric)
    K[qids[:, None] == docs[None, :]] = np.inf
    order = np.lexsort((np.broadcast_to(docs, K.shape), K), axis=-1)
    acc, parts = None, np.array_split(np.arange(4500), 3)
    for part in parts:
        acc = knn.topk_merge(Q, qids, C[part], docs[part], 9, metric, True, acc)
    assert (acc[1] == docs[order[:, :9]]).all() and np.allclose(acc[0], np.take_along_axis(K, order[:, :9], 1), rtol=1e-12, atol=1e-12)

    frames = [pd.DataFrame({"doc_id": docs[p], "c_mod": "t", "vec": list(C[p]), "rel_key": other[p]}) for p in parts]
    found = next(knn._best_by_key_kernel(metric, True)({"i": (qids, Q, label)}, iter(frames))).sort_values("qid")
    first = [next(j for j in order[i] if other[j] == label[i]) for i in range(600)]
    assert (found["best_doc"].to_numpy() == docs[first]).all()
    blocks = {("i", "t"): (qids, Q, found["best_key"].to_numpy(), found["best_doc"].to_numpy())}
    counted = next(knn._count_before_kernel(metric, True)(blocks, iter(frames))).set_index("qid")["n_before"]
    assert [counted.get(i, 0) for i in range(600)] == [list(order[i]).index(first[i]) for i in range(600)]


def test_kernels_hold_small_tiles():
    """Before, a tile had 4M scores and several copies of them."""
    draw = np.random.default_rng(2)
    X = draw.normal(size=(4000, 16))
    ids = np.arange(4000)
    assert peak_mb(lambda: knn.topk_merge(X, ids, X, ids, 10, "ip", True)) < 60
    frame = pd.DataFrame({"grp": 0, "col": ids, "vec": list(X)})
    asked = pd.DataFrame({"grp": 0, "batch_id": 0, "pos": ids, "target": ids, "vec": list(X)})
    assert peak_mb(lambda: list(pairs._contrast_kernel(1.0)((asked, pairs._unit_rows(asked["vec"]), pairs._rows_by_group(asked)), [frame]))) < 60


def test_first_scores_are_held_in_portions():
    """Before, the first candidates of 512 queries had all their scores in double precision, several times over."""
    draw = np.random.default_rng(3)
    X, ids = draw.normal(size=(2048, 16)), np.arange(2048)
    assert peak_mb(lambda: knn.topk_merge(X, ids, X, ids, 10, "ip", True)) < 20


def test_probes_are_not_stored(spark, monkeypatch):
    """What a cell search writes is each table once, however many cells a query visits."""
    q, p = drawn(spark, 3, 30, 400)
    want = rows_of(knn.search_topk(q, p, 5))
    written, kept = [], tiles.tiled
    monkeypatch.setattr(tiles, "tiled", lambda df, *a, **b: (written.append(df.count()), kept(df, *a, **b))[1])
    monkeypatch.setattr(ivf, "materialize", lambda df: pytest.fail("a round was written"))
    cells = ivf.Cells(p, ivf.train_cells(p, 12), 50)
    assert rows_of(ivf.search_cells(q, cells, 5, 1, reach=1.0)) == want
    assert sum(written) == q.count() + p.count()


@pytest.mark.parametrize("factory,exact", [("PQ4", True), ("PCA3,SQ8", True), ("IVF4,PQ4", False), ("LSH64", False)])
def test_candidate_pairs_are_not_rows(spark, monkeypatch, factory, exact):
    """Rows that codes don't rule out are scored in the task that reads them, and not joined as pairs."""
    q, p = drawn(spark, 4, 20, 200)
    want = rows_of(knn.search_topk(q, p, 4))
    monkeypatch.setattr(coded, "_ranked", lambda *a: pytest.fail("candidate pairs were joined"))
    assert rows_of(index.Index(p, factory, tile_rows=60).search(q, 4, nprobe=16, shortlist=300, exact=exact)) == want


def test_next_round_visits_as_many_cells_again():
    key = np.array([[0.0, 1.0, 1.0, 2.0, 3.0, 4.0]] * 4)
    at, worst = np.array([0, 2, 3, 3]), np.array([np.inf, np.inf, 0.5, 2.0])
    assert ivf._following(key, at, worst, 2, 1.0).tolist() == [3, 4, 3, 4]
    assert ivf._following(key, at, worst, 2, None).tolist() == [3, 4, 3, 3]


def test_screen_needs_no_new_tiles():
    """Before, every tile of numbers and of marks was a new array."""
    draw = np.random.default_rng(5)
    X = draw.normal(size=(6000, 8))
    screen = knn.Screen(X[:40], X, "ip")
    first = screen.tile(slice(0, 40), 0, 2048)
    marked = screen.marks("may", np.greater_equal, first, np.zeros(40, np.float32))
    assert np.shares_memory(screen.tile(slice(0, 40), 2048, 4096), first)
    assert np.shares_memory(screen.marks("may", np.greater_equal, first, np.zeros(40, np.float32)), marked)
    odd = screen.tile(slice(3, 10), 5, 1206)                     # a width that isn't one of whole words
    mask = screen.marks("may", np.greater_equal, odd, np.full(7, 1.5, np.float32))
    assert mask.shape == (7, 1208) and not mask[:, 1201:].any()
    assert [x.tolist() for x in knn._marked(mask)] == [x.tolist() for x in np.nonzero(odd >= 1.5)]


@pytest.mark.parametrize("width", [5, 8, 2048, 8 * 600])
def test_rows_are_counted_by_words(width):
    draw = np.random.default_rng(6)
    for share in (0.0, 0.01, 1.0):
        mask = draw.random((9, width)) < share
        assert knn._per_row(mask).tolist() == mask.sum(axis=1).tolist()


def test_few_and_many_marks():
    draw = np.random.default_rng(7)
    for empty in (0, 30):                                        # with most rows marked, and with few
        mask = np.zeros((40, 256), bool)
        mask[empty:, :5] = True
        mask[35] = draw.random(256) < 0.9
        want = mask.copy()
        want[35] = False
        r, c, many = knn._few(mask)
        assert many.tolist() == [35] and [r.tolist(), c.tolist()] == [x.tolist() for x in np.nonzero(want)]


def test_new_entries_are_merged_into_sorted_lists(monkeypatch):
    """Before, a list and its new entries were sorted anew, by three keys."""
    draw = np.random.default_rng(8)
    acc, every = knn.empty_topk(30, 9), []
    for step in range(6):
        rows, keys, docs = draw.integers(0, 30, 300), draw.integers(-4, 5, 300).astype(float), draw.integers(0, 99, 300)
        keys[::11] = np.inf
        knn._insert(*acc, rows, keys, docs)
        every += list(zip(rows, keys, docs))
    for i in range(30):
        want = sorted((k, d) for r, k, d in every if r == i and np.isfinite(k))[:9]
        assert list(zip(acc[0][i], acc[1][i])) == want
    sizes, sort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys, axis=-1: (sizes.append(np.asarray(keys[0]).size), sort(keys, axis=axis))[1])
    acc = knn.empty_topk(50, 200)
    acc[0][:], acc[1][:] = np.arange(200.0), np.arange(200)
    knn._insert(*acc, np.arange(50), np.full(50, 3.5), np.full(50, 7))
    assert sizes == [50] and (acc[0][:, 4] == 3.5).all() and (acc[1][:, 4] == 7).all() and acc[0].max() == 198


def test_an_encoder_keeps_few_tokens(monkeypatch):
    """Before, an encoder kept up to two million tokens, in every worker and for each column."""
    monkeypatch.setattr(encode, "CACHED_TOKENS", 50)
    made = encode.HashingEncoder()
    texts = np.array([" ".join(f"w{i * 7 + j}" for j in range(30)) for i in range(40)], dtype=object)
    got = np.concatenate([made(texts[a: a + 4]) for a in range(0, 40, 4)])
    assert len(made._cache) <= 50
    assert (got == np.stack([encode.HashingEncoder().encode_text(t) for t in texts])).all()


def test_first_lists_come_from_few_candidates(monkeypatch):
    """Before, the first 2,048 candidates of a query were all scored in double precision."""
    draw = np.random.default_rng(9)
    X, ids, scored = draw.normal(size=(300, 8)), np.arange(300), []
    C, docs, keys = draw.normal(size=(6000, 8)), draw.permutation(6000), knn._keys
    want = np.lexsort((np.broadcast_to(docs, (300, 6000)), keys(X, C, "ip")), axis=-1)[:, :5]
    monkeypatch.setattr(knn, "_keys", lambda Q, C, metric: (scored.append(len(Q) * len(C)), keys(Q, C, metric))[1])
    found = knn.topk_merge(X, ids, C, docs, 5, "ip", False)
    assert (found[1] == docs[want]).all() and sum(scored) <= 300 * 2 * knn.FIRST_COLS


def test_rows_below_their_bound_are_not_marked(monkeypatch):
    """Before, every number of a tile was compared and marked, in rows without any of interest too."""
    draw = np.random.default_rng(10)
    X = draw.normal(size=(400, 8))
    screen, found = knn.Screen(X, X, "ip"), None
    found = screen.tile(slice(0, 400), 0, 400)
    found[7] = np.nan
    least = np.full(400, 1e9, np.float32)
    least[[3, 9]], sizes, marks = 5.0, [], screen.marks
    monkeypatch.setattr(screen, "marks", lambda name, compare, part, bound: (sizes.append(part.shape), marks(name, compare, part, bound))[1])
    rows, cols, many = screen.passing(found, least, 400)
    assert [rows.tolist(), cols.tolist()] == [x.tolist() for x in np.nonzero(found >= least[:, None])] and len(many) == 0
    assert sizes[0][0] <= 2
    assert [len(x) for x in screen.passing(found, np.full(400, np.inf, np.float32))] == [0, 0, 0]


def test_blocks_are_scored_as_one(monkeypatch):
    """Before, each query modality had products of its own."""
    draw = np.random.default_rng(11)
    Q, C, calls, merge = draw.normal(size=(60, 5)), draw.normal(size=(90, 5)), [], knn.topk_merge
    blocks = {"i": (np.arange(40), Q[:40]), "none": (np.arange(0), np.zeros((0, 0))), "t": (np.arange(20), Q[40:])}
    monkeypatch.setattr(knn, "topk_merge", lambda *a, **b: (calls.append(len(a[1])), merge(*a, **b))[1])
    found = pd.concat(knn._topk_kernel(3, "ip", False)(blocks, iter([pd.DataFrame({"doc_id": np.arange(90), "c_mod": "x", "vec": list(C)})])))
    assert calls == [60] and found.groupby("q_mod").size().to_dict() == {"i": 120, "t": 60}
    for (q_mod, qid), g in found.groupby(["q_mod", "qid"]):
        want = np.argsort(-(C @ Q[qid + 40 * (q_mod == "t")]))[:3]
        assert set(g["doc_id"]) == set(want)


def test_a_query_is_stored_once_with_its_thresholds(spark):
    """Before, a query's vector was stored for every modality of the pool."""
    q, p = drawn(spark, 14, 12, 60)
    thresholds = spark.createDataFrame([(i, m, c, -0.5, i) for i in range(12) for m in ("i", "t") for c in ("i", "t") if i or c == "i"],
                                       "qid long, q_mod string, c_mod string, best_key double, best_doc long")
    held = knn.with_thresholds(q, thresholds)
    assert held.count() == 24
    cells = knn._payload_by_cell(held.toPandas())
    assert {cell: len(v[0]) for cell, v in cells.items()} == {("i", "i"): 12, ("t", "i"): 12, ("i", "t"): 11, ("t", "t"): 11}
    counts = [sorted(map(tuple, knn.count_before(q, p, thresholds, min_blocks=n).collect())) for n in (1, 3)]
    assert counts[0] == counts[1] and len(counts[0]) > 0


def coded_frames(draw, X, docs, codec, centroids, cell, parts):
    """The rows of a coded pool, as its tiles hold them."""
    codes = codec.encode(X - centroids[cell])
    off = np.sqrt(np.square(X - centroids[cell] - codec.decode(codes)).sum(1))
    sq = np.square(codec.decode(codes) + centroids[cell]).sum(1)
    held = pd.DataFrame({"doc_id": docs, "cell": cell, "code": [c.tobytes() for c in codes], "sq": sq, "off": off, "vec": list(X)})
    return [g for p in np.array_split(draw.permutation(len(X)), parts) for _, g in held.iloc[p].groupby("cell")]


def some_codec(draw, X, kind):
    if kind == "product":
        return coded.ProductCodec(np.stack([X[draw.integers(0, len(X), coded.CODES), 2 * s: 2 * s + 2] for s in range(3)]))
    basis = np.linalg.qr(draw.normal(size=(6, 6)))[0][:4]
    return coded.ScalarCodec(basis, np.full(4, -4.0), np.full(4, 8.0 / coded.LEVELS))


@pytest.mark.parametrize("kind", ["product", "scalar"])
@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_codes_rule_out_in_single_precision(monkeypatch, kind, metric):
    """Before, all coded scores were made in double precision, twice, and a pass of its own took the worst cases."""
    draw = np.random.default_rng(12)
    X, Q = odd_vectors(draw, 5000, "plain"), odd_vectors(draw, 700, "plain")
    qids, docs = np.arange(700), draw.permutation(9000)[:5000]
    docs[7:9] = docs[5]                                           # an id that comes more than once
    codec, centroids = some_codec(draw, X, kind), draw.normal(size=(3, 6)) * 0.2

    class Model:
        value = codec, centroids
    frames = coded_frames(draw, X, docs, codec, centroids, draw.integers(0, 3, 5000), 2)
    monkeypatch.setattr(ivf, "frames_of", lambda *a: ((0, f) for f in frames))
    if metric == "ip":
        monkeypatch.setattr(coded, "coded_keys", lambda *a: pytest.fail("scored in double precision"))
    best_k, best_d = coded._exact_within(Model, None, Q, qids, "i", 9, metric, True)
    K = knn._keys(Q, X, metric)
    K[qids[:, None] == docs[None, :]] = np.inf
    order = np.lexsort((np.broadcast_to(docs, K.shape), K), axis=-1)[:, :9]
    assert (best_d == docs[order]).all() and np.allclose(best_k, np.take_along_axis(K, order, 1), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("kind", ["product", "scalar"])
def test_ceilings_hold(kind):
    draw = np.random.default_rng(13)
    X, Q = draw.normal(size=(300, 6)), draw.normal(size=(40, 6))
    centroids = draw.normal(size=(1, 6))
    codec = some_codec(draw, X, kind)
    frame = coded_frames(draw, X, np.arange(300), codec, centroids, np.zeros(300, int), 1)[0]
    screen = coded.ceilings((codec, centroids), Q, frame)
    true = Q @ np.stack(frame["vec"]).T
    assert all((screen.tile(slice(0, 40), 0, 300)[:, j] >= screen.least(np.arange(40), -true[:, j])).all() for j in range(300))
    want = Q @ (codec.decode(coded._codes(codec, frame)) + centroids[0]).T + np.linalg.norm(Q, axis=1)[:, None] * frame["off"].to_numpy()
    assert np.allclose(screen.tile(slice(0, 40), 0, 300), want, atol=1e-4)


def test_lists_that_all_ask_are_not_copied(monkeypatch):
    """Before, the queries and their lists were copied out and back for every cell."""
    draw = np.random.default_rng(14)
    X, seen = draw.normal(size=(90, 4)), []

    class Cells:
        cells, mods, centroids = {"i": np.arange(3)}, ["i"], X[:3]

        def bounds(self, Q, *a):
            return np.zeros((len(Q), 3))
    monkeypatch.setattr(ivf, "frames_of", lambda *a: ((j, pd.DataFrame({"doc_id": np.arange(j * 30, j * 30 + 30), "vec": list(X[j * 30: j * 30 + 30])})) for j in range(3)))
    plain = ivf._by_vectors(4, "ip", False)
    scoring = ivf.Scoring(lambda Q, qids, frame, acc: (seen.append(acc[0]), plain.merge(Q, qids, frame, acc))[1], plain.columns, plain.kernel)
    acc, visited = ivf.visit(Cells(), X[:20], np.arange(20), "i", 4, 3, "ip", None, scoring)
    assert len(seen) == 3 and all(x is acc[0] for x in seen) and visited.all()
    assert (acc[1] == np.argsort(-(X[:20] @ X.T), axis=1)[:, :4]).all()
