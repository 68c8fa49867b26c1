import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import pytest

from seqloom.llm import ann as A
from seqloom.llm import repair as R
from seqloom.llm import whitening as W

BLANKS = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
LONG = {"u": "user", "a": "assistant"}


def brute_repair(rows):
    """Edits from the end on: the rest of an audit and its cost for each turn and role before it, spelled out."""
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif kind == 4:
            role = "user"
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in kept:
            end = text.rstrip(BLANKS)[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "fine" if end in ".!?" else "truncated")
            seen.add((role, text))

        @lru_cache(None)
        def best(i, state, inserted=0):
            ways = []
            if i == len(kept) and state in ("", "a"):
                ways.append((0, "", ()))
            if inserted < 3:
                for r in "ua":
                    if (state, r) in NEXT:
                        c, s, out = best(i, r, inserted + 1)
                        ways.append((c + 5, "I" + s, (LONG[r] + ":", *out)))
            if i < len(kept):
                _, role, text = kept[i]
                c, s, out = best(i + 1, state)
                ways.append((c + 2, "D" + s, out))
                if faults[i] in ("fine", "truncated"):
                    for to, edit, cost in ((role[:1], "K", 0), ("u", "R", 1), ("a", "R", 1)):
                        if (state, to) in NEXT:
                            c, s, out = best(i + 1, to)
                            ways.append((c + cost + 5 * (faults[i] == "truncated"), edit + s, ((role if edit == "K" else LONG[to]) + ":" + text, *out)))
            return min(ways, default=(10**9, "", ()), key=lambda w: w[:2])

        cost, audit, told = best(0, "")
        turns = [t for t, _, _ in kept if t is not None]
        odd = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), odd, cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest()))
    return sorted(out, key=str)


def talk(rng, conv, n):
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "u"], ["Yes.", "No!", "why? ", "cut off", " \t", "", None, "x\n.\r", "é\x85"]
    return [(conv, rng.choice([k, k, k + 1, None, k * 3]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"{rng.random()}{rng.choice('.!,')}") for k in range(n)]


@pytest.mark.parametrize("parts", [1, 7])
def test_repair(spark, parts):
    rng = random.Random(parts)
    rows = [r for c in range(60) for r in talk(rng, c, rng.randint(1, 9))] + talk(rng, None, 6) + talk(rng, 1000, 150) + [(2000, k, "user", f"{k}.") for k in range(40)] + [(2001, k, "tool", "same") for k in range(30)]
    rows += [(3000, 0, "user", "long " * 100_000), (3001, 2**62, "user", "far."), (3001, -(2**62), "user", "off.")]
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, part int, fault string, at long")
    got = sorted((tuple(r) for r in R.repair(table, parts).collect()), key=str)
    want = [r if r[0] != 3001 else (r[0], 0, *r[2:]) for r in brute_repair(rows)]
    assert got == want


def test_repair_of_nothing(spark):
    shape = "conv_id long, turn long, role string, text string"
    assert R.repair(spark.createDataFrame([], shape)).isEmpty()
    gone = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    row = R.repair(spark.createDataFrame([(gone, 0, "user", "Hello.")], shape)).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_parts_join_to_the_whole():
    rng = random.Random(3)
    for _ in range(300):
        turns = [(rng.choice(["s", "u", "a", "t"]), rng.choice([R.FINE, R.FINE, R.GONE, R.CUT])) for _ in range(rng.randint(1, 14))]
        whole = R.chosen([R.part_minima(True, turns)], len(turns))
        cuts = sorted(rng.sample(range(1, len(turns)), min(len(turns) - 1, rng.randint(0, 4)))) if len(turns) > 1 else []
        pieces = [turns[a:b] for a, b in zip([0, *cuts], [*cuts, len(turns)])]
        cost, ends = R.chosen([R.part_minima(k == 0, p) for k, p in enumerate(pieces)], len(turns))
        assert cost == whole[0]
        told = [e for p, begin, end in zip(pieces, ["", *ends], ends) for e in R.part_edits(p, begin, end)]
        assert told == R.part_edits(turns, "", whole[1][-1]) and ends[-1] == whole[1][-1]


def brute_whitening(x, k=32):
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    return ((n * x - s) ** 2).sum(1), c @ q / np.sqrt(np.maximum(e, 1e-300)), e / np.trace(v)


def whitened(rows):
    return {(r.vec_id, r.component): r for r in rows.collect()}


def test_whitening(spark):
    rng = np.random.default_rng(2)
    m = rng.standard_normal((300, 12)) * np.linspace(3, 0.3, 12)
    rows = [(k, v.tolist(), 1) for k, v in enumerate(m)] + [(500, None, 1), (501, [1.0] * 11 + [None], 1), (502, [float("nan")] * 12, 1), (503, [float("-inf")] * 12, 1), (504, [1.0, 2.0], 1), (505, [], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    x = np.concatenate([np.floor(64 * m), [np.floor(64 * np.array([1.0, 2.0] + [0.0] * 10)), np.zeros(12)]]).astype(np.int64) + 1_000_000
    deviation, want, explained = brute_whitening(x)
    for options in ({}, {"k": 3, "block": 5}):
        got, k = whitened(W.whiten(table, **options)), options.get("k", 12)
        assert set(got) == {(i, c) for i in [*range(300), 504, 505] for c in range(1, k + 1)}
        for c in range(1, k + 1):
            mine = np.array([got[i, c].whitened for i in [*range(300), 504, 505]])
            assert np.abs(mine * np.sign(mine @ want[:, c - 1]) - want[:, c - 1]).max() < 1e-9
            assert abs(got[0, c].explained / explained[c - 1] - 1) < 1e-12 and got[0, c].identity_error < 1e-9 and got[0, c].n == 302
        assert [got[i, 1].deviation for i in range(300)] == deviation[:300].tolist()


def test_whitening_of_odd_tables(spark):
    shape = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0]), (None, [1.0])], [(1, None)]):
        assert W.whiten(spark.createDataFrame(rows, shape)).isEmpty()
    got = W.whiten(spark.createDataFrame([(1, [1.0, 0.0]), (1, [-1.0, 0.0]), (None, [1e38, 0.0])], shape)).collect()
    assert len(got) == 3 and {r.component for r in got} == {1} and all(r.deviation is None for r in got if r.vec_id is None) and got[0].identity_error < 1e-4
    with pytest.raises(RuntimeError, match="passes"):
        W.whiten(spark.createDataFrame([(k, [float(k % 7), float(k % 5), float(k % 3)]) for k in range(50)], shape), k=1, block=1, passes=2)


def brute_near(vectors, k, every):
    width = max(len(v) for _, v in vectors)
    m = np.array([list(v) + [0.0] * (width - len(v)) for _, v in vectors])
    ids = np.array([i for i, _ in vectors])
    out = []
    for a in np.flatnonzero(ids % every == 0):
        far = np.sqrt(((m - m[a]) ** 2).sum(1))
        best = [b for b in np.lexsort((ids, far)) if b != a][:k]
        out += [(int(ids[a]), r, int(ids[b]), float(far[b])) for r, b in enumerate(best, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 8)) * 4
    rows = [(k, (centres[rng.integers(40)] + rng.standard_normal(8)).astype(np.float32).astype(float).tolist()) for k in range(3000)]
    copies = [(5000 + k, rows[7][1]) for k in range(900)]
    return [*rows, *copies, (6000, [1.0, 2.0]), (6000, [1.0, 2.0])]


SHAPE = "vec_id long, embedding array<double>, leaf int, row long"


def test_near_reaches_its_recall(spark, vectors):
    odd = [(100, None), (200, [float("nan")] * 8), (300, [0.0] * 8), (400, []), (500, [None, 1.0]), (None, vectors[0][1])]
    table = spark.createDataFrame([(*r, 1, 2) for r in [*vectors, *odd]], SHAPE)
    got = A.near(table, query_every=50, leaves=60, chunk=200, crowd=20).collect()
    want = brute_near(vectors, 10, 50)
    score = {(q, v): s for q, _, v, s in want}
    assert {r.query_id for r in got} == {q for q, *_ in want} and len(got) == len(want)
    hits = [(r.query_id, r.vec_id) in score for r in got]
    assert np.mean(hits) > 0.9 and got[0].leaves < 40 and got[0].calibrated_recall >= 0.95
    assert all(abs(r.score - score[r.query_id, r.vec_id]) < 1e-12 for r, hit in zip(got, hits, strict=True) if hit)
    for q in {r.query_id for r in got}:
        mine = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q and q != 6000)
        assert [r for r, *_ in mine] == list(range(1, len(mine) + 1)) and sorted(mine, key=lambda r: r[1:]) == mine


def test_near_of_all_leaves_is_exact(spark, vectors):
    table = spark.createDataFrame([(*r, 1, 2) for r in vectors], SHAPE)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in A.near(table, query_every=500, leaves=30, recall=1.0, calibration=10**6).collect())
    want = brute_near(vectors, 10, 500)
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want], rtol=1e-14, atol=0)


def test_near_of_odd_tables(spark):
    assert A.near(spark.createDataFrame([], SHAPE)).isEmpty() and A.near(spark.createDataFrame([(1, [1.0], 0, 0)], SHAPE)).isEmpty()
    assert A.near(spark.createDataFrame([(100, [1.0], 0, 0)], SHAPE)).isEmpty()
    got = A.near(spark.createDataFrame([(0, [1.0], 0, 0), (0, [1.0], 0, 0), (3, [2.0, 1.0], 0, 0)], SHAPE)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 0), (0, 1, 0), (0, 2, 3), (0, 2, 3)]


def test_best_bin_first_order(vectors):
    m = np.array([v for _, v in vectors if len(v) == 8])
    tree = A.fit(m[:1000], 50)
    assert len(tree.leaf) == 50 and set(tree.assign(m)) <= set(range(50))
    walks = tree.walk(m[:20], 50)
    assert all(sorted(w) == list(range(50)) for w in walks) and (tree.walk(m[:20], 7) == walks[:, :7]).all()
    assert (walks[:, 0] == tree.assign(m[:20])).mean() > 0.9
    assert len(A.fit(np.ones((50, 3)), 10).leaf) == 1
