import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import ngram_join as J
from seqloom.llm import suffix_dedup as X
from seqloom.llm import topk as T
from seqloom.llm.components import merge_components


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_classes(rows, percent=80):
    sets = []
    for _, t, *_ in rows:
        w = lower(t).split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, *_) in enumerate(rows):
        least[root(k)].append(i)
    return sorted((str(i), len(sets[k]), str(min((x for x in least[root(k)] if x is not None), default=None)) if sets[k] else str(i)) for k, (i, *_) in enumerate(rows))


def near_rows():
    """Classes of every kind: chains of edits, copies, borders of similarity, a passage shared by texts that are not alike."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage, rows, n = [word() for _ in range(30)], [], 0
    for size in (5, 6, 9, 40, 80, 200):
        for _ in range(3):
            base = [word() for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, 3, 4):
                text = list(base)
                for at in rng.sample(range(size), min(edits, size)):
                    text[at] = word()
                base = text if rng.random() < 0.3 else base
                rows.append((n := n + 1, " ".join(text), None))
    rows += [(n := n + 1, " ".join([*passage, *[word() for _ in range(rng.choice((2, 6, 8, 20)))]]), None) for _ in range(30)]
    rng.shuffle(rows)
    return [*rows, (900, "A b C", None), (901, "a B c", None), (902, "a b", None), (903, None, None), (904, " \n", None), (None, "a b c", None), (905, "one two three four five", None), (905, "one two three four five", None), (906, "q " * 30_000, None), (907, "Q\tq " * 7, None)]


def test_near(docs):
    rows = near_rows()
    for rounds in (0, 1, 5):
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.near_duplicates(docs(*rows), rounds=rounds).collect())
        assert got == brute_classes(rows)


def test_near_empty_and_keep(docs):
    rows = [(3, "a b c d e f g h", None), (1, "A b c d e f g h", None), (2, "x", None), (4, None, None), (5, "", None)]
    assert J.near_duplicates(docs(*rows).limit(0)).isEmpty()
    kept = J.keep_one_each(docs(*rows))
    assert kept.columns == docs(*rows).columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 2, 4, 5]


def test_near_keeps_one_row_of_repeated_and_null_ids(docs):
    a, b, c = ("".join(f"{w}{k} " for k in range(40)) for w in "abc")
    rows = [(1, a, None), (2, a + "end", None), (2, b, None), (None, c, None), (None, c + "end", None), (None, "", None), (7, "other words that stand alone here", None), (7, c + "more", "s")]
    kept = J.keep_one_each(docs(*rows))
    assert kept.columns == docs(*rows).columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", a), ("2", b), ("7", c + "more"), ("7", rows[6][1]), ("None", "")])
    kept = J.keep_one_each(docs(*rows[3:6])).collect()
    assert len(kept) == 2 and [r.text for r in kept if r.text] and all(r.text in ("", c, c + "end") for r in kept)
    assert J.keep_one_each(docs((5, a, None), (5, a + "end", None))).count() == 1


def test_components(spark):
    comps = spark.range(50).selectExpr("id AS did", "id AS comp")
    links = spark.createDataFrame([(k, k + 2) for k in range(0, 46, 2)] + [(9, 7), (7, 5)], "a long, b long")
    got = {r.did: r.comp for r in merge_components(comps, links).collect()}
    assert all(got[k] == 0 for k in range(0, 48, 2)) and got[9] == got[7] == got[5] == 5 and got[11] == 11


def brute_suffix(rows, n=200):
    raw = [(i, (t or "").encode()) for i, t, *_ in rows]
    count = Counter(b[k : k + n] for _, b in raw for k in range(len(b) - n + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - n + 1):
            if count[b[k : k + n]] > 1:
                gone[k : k + n] = 1
        gone = gone[: len(b)]
        out.append((str(i), len(b), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[gone == 0].tobytes()).hexdigest()))
    return sorted(out)


def suffix_rows():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abcdeé \n", k=n))
    shared = [text(k) for k in (150, 190, 200, 201, 260, 700)]
    rows = [(k, text(rng.randint(0, 300)) + rng.choice(shared)[rng.choice((0, 0, 3)) :] + text(rng.randint(0, 300)) + rng.choice(shared), None) for k in range(60)]
    copy = text(900)
    rows += [(100, copy, None), (101, copy, None), (101, copy, None), (102, copy[:450] + "X" + copy[450:], None), (103, "ab" * 400, None), (104, "a" * 201, None), (105, "a" * 199, None), (106, "abcdefghij" * 45, None)]
    return [*rows, (107, "\x00" * 450, None), (108, "a" * 250 + "\x00" * 210, None), (109, None, None), (None, copy[100:500], None), (110, "", None), (111, text(40_000), None)]


@pytest.mark.parametrize("anchor", [1, 130, 200])
def test_suffix(docs, anchor):
    rows = suffix_rows()
    got = X.suffix_dedup(docs(*rows), anchor=anchor).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_suffix(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_suffix_parts_follow_from_the_bytes(docs, monkeypatch):
    """However few partitions the session has, no part holds more of a larger corpus."""
    rows = suffix_rows()
    monkeypatch.setattr(X, "PART_BYTES", 4 << 10, raising=False)
    monkeypatch.setattr(X, "PART_OPEN", 2 << 10, raising=False)
    monkeypatch.setattr(X, "TASK_BLOCKS", 1, raising=False)
    held = {}

    def told(df, name, write=X.written):
        out = write(df, name)
        if name.startswith(("suffix-contexts", "suffix-N", "suffix-R")):
            held[name] = [r.n for r in out.where("kind >= 0").groupBy("part").agg(F.sum(F.length("payload")).alias("n")).collect()]
        return out

    monkeypatch.setattr(X, "written", told)
    got = X.suffix_dedup(docs(*rows)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_suffix(rows)
    assert len(held["suffix-contexts"]) > 4 and len(held["suffix-R0"]) > 4
    assert max(held["suffix-N3"]) < sum(held["suffix-N3"]) / 5 and max(held["suffix-R0"]) < sum(held["suffix-R0"]) / 5


def test_suffix_longer_than_243_bytes(docs):
    """A level more; a level's needs are the names below it and the ranks above it."""
    rows = [(k, t and t * (3 if (k or 0) % 7 == 0 else 1), None) for k, t, _ in suffix_rows() if t is None or len(t) < 5000]
    got = X.suffix_dedup(docs(*rows), length=300, anchor=190).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_suffix(rows, 300)
    assert X.Stages(200).needs == {"N3": [], "N4": ["N3"], "N5": ["N3", "N4"], "R4": ["N3", "N4", "N5"], "R3": ["N3", "N4", "R4"], "R2": ["N3", "R3"], "R1": ["R2"], "R0": ["R1"]}


def test_suffix_empty(docs):
    assert X.suffix_dedup(docs((1, "a", None)).limit(0)).isEmpty()
    assert X.suffix_dedup(docs((1, "a", None), (2, None, None))).count() == 2


def test_merged_order():
    rng = np.random.default_rng(0)
    text = np.append(rng.integers(0, 2, 90), [0, 0, 0, 0])
    suffix = [tuple(text[k:90]) for k in range(94)]
    rank = {k: r for r, k in enumerate(sorted(range(94), key=lambda k: suffix[k]))}
    at = np.arange(90)
    digit = at % 3
    own, one, two = (np.array([rank[k + j] for k in at]) for j in range(3))
    order = X.merged_order(digit, np.where(digit == 0, one, own), np.where(digit == 1, one, two), (text[at] * 2 + text[at + 1]), ties=False)
    real = [k for k in sorted(range(90), key=lambda k: suffix[k])]
    assert [suffix[k] for k in order] == [suffix[k] for k in real] or list(order) == real


def vectors(kind):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(300)]
    if kind == "clusters":
        rows = [(k, (10 * (k % 4) + 0.01 * rng.normal(size=8)).tolist()) for k in range(300)] + [(400 + k, [1.0] * 8) for k in range(80)]
    odd = [(500, None), (501, []), (550, [1.0, None]), (502, [float("nan")]), (503, [float("inf"), 1.0]), (None, [1.0] * 8), (600, [0.5] * 3), (600, [0.5] * 3), (-50, [0.0] * 8), (700, [1e6] * 8)]
    return rows + odd


@pytest.mark.parametrize(("kind", "cell", "block", "crowd"), [("spread", 8192, 2048, 65_536), ("clusters", 20, 3, 2)])
def test_top_k(spark, kind, cell, block, crowd):
    rows = vectors(kind)
    frame = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, v string")
    got = defaultdict(list)
    for r in T.top_k(frame, cell=cell, block=block, crowd=crowd).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    valid = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = defaultdict(list)
    for q, (i, v) in enumerate(valid):
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for c, (j, w) in enumerate(valid) if c != q)[:5]  # noqa: B905
            want[i] += [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}


def test_top_k_few(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in T.top_k(frame).collect()] == [(0, 1, 1, 256 * 512)]
    assert T.top_k(frame.limit(0)).isEmpty() and T.top_k(frame.limit(1)).isEmpty()


def test_rings_are_cut_by_distance():
    stats = [{"pivot": 0, "n": 100, "cuts": list(np.linspace(0, 10, T.CUTS + 1))}, {"pivot": 1, "n": 7, "cuts": [3.0] * (T.CUTS + 1)}]
    cells = T.Cells(np.zeros((2, 3)), stats, 25)
    assert cells.rings == 5 and cells.ring(np.array([0, 0, 0, 1]), np.array([0.1, 5.1, 9.9, 3.0])).tolist() == [0, 2, 3, 4]
    cells.fill([{"ring": 4, "pivot": 1, "n": 160, "lo": 3.0, "hi": 3.0}], 25)
    assert cells.salts.tolist() == [1, 1, 1, 1, 4] and set(cells.place(np.full(99, 4), np.arange(99))) == {4, 5, 6, 7}


def test_pipeline(spark, docs, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    base = "the quick brown fox jumps over the lazy dog and runs far away from every other animal in sight today "
    rows = [(k, f"{base * 3}number{k} " + "word%d " % k * 40, f"s{k % 3}") for k in range(40)]
    rows += [(50, rows[3][1], "s1"), (51, rows[4][1] + " end", "s2"), (52, "123 !", "s1"), (53, None, None), (54, "", None)]
    frame = docs(*rows)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, frame, str(tmp_path))
        if name == "packing":
            break
        assert after.columns == frame.columns
        after.write.parquet(f"{tmp_path}/{name}")
        ids = [r.doc_id for r in after.select("doc_id").collect()]
        gone = {"language_id": {52, 53, 54}, "exact_dedup": {50, 52, 53, 54}, "near_dedup": {50, 51, 52, 53, 54}}.get(name)
        assert gone is None or sorted(ids) == sorted({r[0] for r in rows} - gone)
        before, frame = frame, spark.read.parquet(f"{tmp_path}/{name}")
    size = lambda df: sum(len(r.text.split()) for r in df.select("text").collect())
    assert abs(size(frame) - 1.5 * size(before)) <= 3
    assert after.count() >= frame.count() and corpus_pipeline.run(spark, str(tmp_path)).count() == after.count()
    frame.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").isEmpty()
