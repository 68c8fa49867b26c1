import hashlib
import random
import zlib

import numpy as np
import pytest

from seqloom.llm import chat as C
from seqloom.llm import langid as G
from seqloom.llm import line_dedup as L
from seqloom.llm import packing as P

WS = " \t\n\x0b\x0c\r"
LINES = [(k, f"  Shared LINE\t\nown {k}\n\nshared line", None) for k in range(9)] + [(9, "x\nSHARED line\ny\x85", None), (9, "x\nSHARED line\ny\x85", None), (None, None, None), (11, "", None), (12, "É\né\n" * 20_000, None)]


def lower(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute_lines(rows, min_docs=10, min_chars=1):
    count = {}
    for _, t, *_ in rows:
        for k in {lower(x) for x in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (len(lower(x)) >= min_chars and count[lower(x)] >= min_docs)]
        out.append((str(i), len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out)


def told(rows):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in rows.collect())


@pytest.mark.parametrize("asks", [1, 4, L.ASKS])
def test_lines(spark, docs, asks):
    index = L.LineIndex(spark, keys_per_shard=3)
    index.insert(docs(*LINES))
    assert index.filters.agg({"asks": "sum"}).first()[0] == sum(len({lower(x) for x in (t or "").split("\n")} - {""}) for _, t, _ in LINES)
    assert told(index.dropped(docs(*LINES).repartition(7), asks=asks)) == brute_lines(LINES)


def test_lines_are_reversible(spark, docs):
    more = [(100 + k, f"own {k}\nnew", None) for k in range(12)]
    index = L.LineIndex(spark, min_docs=2)
    index.insert(docs(*LINES))
    before = told(index.dropped(docs(*LINES)))
    index.insert(docs(*more))
    assert told(index.dropped(docs(*LINES, *more))) == brute_lines([*LINES, *more], 2)
    index.delete(docs(*more))
    assert told(index.dropped(docs(*LINES))) == before == brute_lines(LINES, 2)
    assert L.line_dedup(docs(*LINES).limit(0)).isEmpty()


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, (3000, 2), dtype=np.uint64)
    f = L.CuckooFilter(3000)
    assert f.insert(keys) and f.contains(keys).all() and L.CuckooFilter(blob=f.to_bytes()).contains(keys).all()
    assert f.contains(rng.integers(0, 1 << 63, (20_000, 2), dtype=np.uint64)).mean() < 0.01
    f.delete(keys[:1500])
    assert f.contains(keys[1500:]).all() and f.contains(keys[:1500]).mean() < 0.01 and f.n == 1500
    assert not L.CuckooFilter(1).insert(keys)


TEXTS = ["", None, "It's 12 naïve, É don't!", "<|endoftext|> x", "日本\x1cab\x85", "word " * 5000, "a", "a", "  \n "]


def test_packing(docs):
    rows = [(k if k != 6 else None, t, None) for k, t in enumerate(TEXTS)] + [(50 + k, "some words here " * (k % 90), None) for k in range(200)]
    cache = P.word_cache(P.word_tokenizer())
    got = P.pack(docs(*rows), P.word_tokenizer(), pieces_per_node=20, fan=2, handed_on=5).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t, _ in rows:
        ids = [*cache.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in parts] == [(k, a, min(2048, len(ids) - a)) for k, a in enumerate(range(0, len(ids), 2048))]
        assert [r.ids_crc32 for r in parts] == [zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in parts]
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))] and sum(r.length for r in s) <= 2048
    best = P.pack(docs(*rows), P.word_tokenizer()).select("sequence_id").distinct().count()
    assert best <= -(-sum(r.length for r in got) // 2048) + 1
    assert P.pack(docs(*rows).limit(0), P.word_tokenizer()).isEmpty()


ODD_ENDS = ["caf\u00e9\u00a0bar\n", " a\x0cb", "a\u00a0b\n", "\ta\x0b", "\u3000x \n", " \x85", "\n\x1c\n"]


def test_odd_white_space_between_plain_ends(docs):
    cache = P.word_cache(P.word_tokenizer())
    for t in ODD_ENDS:
        assert cache.ids(t) == np.array(cache.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
    assert P.pack(docs(*((k, t, None) for k, t in enumerate(ODD_ENDS))), P.word_tokenizer()).count() == len(ODD_ENDS)


def test_bound_on_bins_costs_no_sequences(spark):
    pieces = spark.range(800).selectExpr("id AS uid", "0 AS piece", "CAST(IF(id % 40 = 0, 1 + id % 900, 1025 + pmod(xxhash64(id), 1000)) AS INT) AS length")
    few, all_ = (P.packed(pieces, pieces_per_node=50, fan=4, handed_on=n).select("sequence_id").distinct().count() for n in (4, 10**9))
    assert few == all_


def test_best_fit():
    bins, offsets, filled = P.best_fit([5, 5, 6, 4, 10], 10)
    assert sorted(filled) == [10, 10, 10] and bins[2] == bins[3] and offsets[3] == 6


def test_language(spark, docs):
    rng = random.Random(4)
    letters = {"aa": "abcdeé", "bb": "fghijk", "cc": "lmnopq"}
    rows = []
    for k in range(240):
        lang = list(letters)[k % 3]
        rows.append((k, " ".join("".join(rng.choices(letters[lang], k=5)) for _ in range(30)), None, lang))
    rows += [(300, None, None, "aa"), (301, "12 -- !", None, "bb"), (302, "", None, None), (None, "abc abc", None, "aa"), (303, "fgh hij" * 50_000, None, None), (1, rows[1][1], None, "bb")]
    got = {}
    for r in G.language_id(docs(*rows)).collect():
        got.setdefault(r.doc_id, r)
    assert all(got[k].lang_pred == list(letters)[k % 3] for k in range(240)) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[k].lang_pred for k in (300, 301, 302, 303)] == ["und", "und", "und", "bb"]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in range(240)) and got[None].held_out is False
    assert G.accepted(docs(*rows)).count() == len(rows) - 3
    assert {r.lang_pred for r in G.language_id(docs((1, "abc", None, None))).collect()} == {"und"}
    assert G.language_id(docs(*rows).limit(0)).isEmpty()


def test_held_out_labels_change_nothing(docs):
    rows = [(k, "abab" if k % 2 else "xyxy", None, "p" if k % 2 else "q") for k in range(60)]
    turned = [(k, t, s, "wrong" if zlib.crc32(str(k).encode()) % 3 == 1 else lang) for k, t, s, lang in rows]
    assert sorted(map(str, G.language_id(docs(*rows)).collect())) == sorted(map(str, G.language_id(docs(*turned)).collect()))


def test_document_frequencies_of_all_training_rows(docs):
    rows = [(k, f"abc {'xyz'[k % 3] * (1 + k % 7)}" if k % 5 else "12", None, "pq"[k % 2]) for k in range(300)]
    model = G.train(docs(*rows), max_train=20)
    texts = [t for k, t, *_ in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    held = [set(G.counts(t)[0].tolist()) for t in texts]
    used = np.zeros(G.DIMENSIONS)
    for h in held:
        used[list(h)] += 1
    assert np.allclose(model.idf, np.log((1 + sum(map(bool, held))) / (1 + used)) + 1)


def test_more_than_200_languages(docs):
    rows = [(k, f"{chr(0x4E00 + k % 230)} " * 5, None, f"l{k % 230:03}") for k in range(1380)]
    assert len(G.train(docs(*rows)).languages) == 230


def test_sparse_weights():
    rows = [(str(k % 2), *G.counts("abc " * 9 if k % 2 else "xyz " * 9)) for k in range(40)]
    model = G.fit(rows)
    assert (model.weights == 0).mean() > 0.99 and model.predict("abc abc")[0] == "1"


def test_chat(spark):
    turns = [("u", "hi"), ("a", "yo"), ("u", "more")]
    rows = [(c, t, *turns[t], "clash") for c, n in ((1, 1), (2, 3), (3, 2), (4, 3)) for t in range(n)] + [(5, 0, "u", "other", ""), (None, 0, None, None, ""), (6, 0, "u", "hi", ""), (6, 0, "u", "hi", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string")
    got = {r.conv_id: (r.n_turns, r.rendered) for r in C.format_chats(frame).collect()}
    show = lambda *ts: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in ts)
    assert got == {2: (3, show(*turns)), 5: (1, show(("u", "other"))), None: (1, show(("", ""))), 6: (2, show(turns[0], turns[0]))}
    assert C.format_chats(frame.limit(0)).isEmpty()
