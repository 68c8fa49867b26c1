"""N-gram Jaccard join by filtering under several global token orders.

A document's set is its distinct 5-word shingles, as 64-bit hashes.  For similarity
0.8 two sets must share a token among the first ``n - ceil(0.8 n) + 1`` tokens of
each, under any global order, so they must under all of them.  The orders here all put
rare tokens first (by the binary logarithm of the number of sets that hold them) and
differ in how they order tokens that are about as rare.

1. Tokens of all documents are counted, packed: a block of documents sends each part of the token
   space one array with its distinct tokens there, and how many of its sets hold each.  A document of whose
   tokens fewer than ``ceil(0.8 n)`` occur in other sets has no partner and goes no further.
2. Documents with equal sets are one from here on; within a block they are one from the start, so a large group
   of copies sends its tokens once a block.  The same exchange, over those that
   are left, gives each set its shared tokens with their frequency, and so its prefixes.
3. The first order's prefixes are the inverted index.  Pairs that share a token there must
   share one under every other order too, and are then verified on their whole sets.
   Pairs already known to be connected need no verification: in each round, every
   component that a token's list holds offers one member, which is compared with that
   of the list's first component.  At last all pairs of different components that are
   still unverified are compared, so no link between different components is lost.
   A list in which all are copies of each other thus costs one comparison per member.
   A pair is compared only if what both sets still have from the shared token on is
   enough (the positional filter); its first shared token always passes this.  At last, lists are
   also split by size, as sets of very different sizes are never linked.

Lists of more than ``HOT`` members (more, where there would be over ``MOST_HOT`` such lists, so their
tokens can be broadcast) are salted: the members are dealt out, and what they are compared with is repeated.  Joins on sets leave a set
that is in very many pairs to Spark's splitting of skewed joins.

Defined results: a null text has no words; sets without tokens are linked with nothing;
fewer words than a shingle are one token; equal texts are linked; null ids never
are the smallest; a very long text is one set, made in one task; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import cache_cleared_by, few_records, finished, join_groups, pack, partitions, remove_table, tidy, unpack, with_locator, written
from seqloom.llm.components import merge_components

WORDS, PERCENT = 5, 80
#: Token orders besides the first.
MORE_ORDERS = 2
#: Rounds of comparisons by one member of each component, at most.
ROUNDS = 5
#: Tokens in a block of documents, about.
BLOCK_TOKENS = 250_000
#: Members from which on a token's list is salted, and most lists of so many or more.
HOT, MOST_HOT = 500, 100_000
#: Bytes in a row that a block sends to itself, at least, and most such rows, which travel apart so that tasks get even shares.
PIECE, PIECES = 16 << 10, 4096
#: Pairs of sets that a worker is handed at once.
PAIRS = 128
#: Identifiers that are broadcast at most, to pick the documents that are left; more are joined by shuffle.
BROADCAST_IDS = 200_000
_K = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_hashes = _Hashes()
cache_cleared_by(_hashes.clear)


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    h = h ^ np.uint64((seed * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    split = (text or "").encode().lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, split), np.uint64, len(split))
    size = min(words, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * _K + w[k : len(w) - size + 1 + k]
    return np.unique(mixed(h))


def least_shared(n, percent: int = PERCENT):
    """Tokens that a set of n shares at least with any set it is linked with."""
    return -(-n * percent // 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


SENT = "part long, block long, payload binary, times binary"


def _send(head: list[bytes], sets: list[np.ndarray], block: int, bits: int, keep: bool = False) -> pd.DataFrame:
    """Rows for the block itself, with what it needs to read the answers (also the tokens, if it is to ``keep`` them), and a
    row per part of the token space (the top bits): the next 40 bits of each distinct token there and how many of the sets hold it."""
    sizes = np.array([len(s) for s in sets], np.uint32)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    owner = np.repeat(np.arange(len(sets)), sizes)[order].astype(np.uint16 if len(sets) <= 1 << 16 else np.uint32)
    every = every[order]
    first = np.flatnonzero(np.append(np.ones(min(1, len(every)), bool), every[1:] != every[:-1]))
    tokens, times = every[first], np.diff(np.append(first, len(every))).astype(np.uint32)
    own = pack(*head, sizes.tobytes(), owner.tobytes(), times.tobytes(), tokens.tobytes() if keep else b"")
    piece = max(PIECE, -(-len(own) // PIECES))
    rows = [{"part": -1 - block * PIECES - j, "block": block, "payload": own[at : at + piece], "times": b""} for j, at in enumerate(range(0, len(own), piece))]
    if len(tokens):
        part = (tokens >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
        low = np.ascontiguousarray(((tokens << np.uint64(bits)) >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5])
        rows += [{"part": int(part[lo]), "block": block, "payload": low[lo:hi].tobytes(), "times": times[lo:hi].tobytes()} for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    return pd.DataFrame(rows)


def _wide(payload: bytes) -> np.ndarray:
    low = np.frombuffer(payload, np.uint8).reshape(-1, 5)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :5] = low
    return out.view(np.uint64).ravel()


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a part of the token space, for each token sent: 0 if one set holds it, else 1 + the binary logarithm of how many do."""
    if rows["part"].iloc[0] < 0:  # blocks' own rows come back as they are
        return rows[["block", "part", "payload"]]
    parts = [_wide(p) for p in rows["payload"]]
    tokens, times = np.concatenate(parts), np.concatenate([np.frombuffer(t, np.uint32) for t in rows["times"]]).astype(np.int64)
    order = np.argsort(tokens, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], tokens[order][1:] != tokens[order][:-1]]))
    held = np.add.reduceat(times[order], first)
    code = np.empty(len(tokens), np.uint8)
    code[order] = np.repeat(np.where(held > 1, 1 + np.log2(held).astype(np.uint8), 0).astype(np.uint8), np.diff(np.append(first, len(tokens))))
    ends = np.cumsum([len(p) for p in parts])
    return pd.DataFrame({"block": rows["block"].to_numpy(), "part": rows["part"].to_numpy(), "payload": [code[e - len(p) : e].tobytes() for p, e in zip(parts, ends, strict=True)]})


def _exchange(sent: DataFrame) -> DataFrame:
    return sent.groupBy("part").applyInPandas(_answer, "block long, part long, payload binary")


def _answered(rows: pd.DataFrame) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Back at a block: what it kept for itself, the sizes of its sets, and set, code and (if kept) token of each token of a set."""
    own = rows["part"] < 0
    *head, sizes, owner, times, tokens = unpack(b"".join(rows[own].sort_values("part", ascending=False)["payload"]))
    sizes, times = np.frombuffer(sizes, np.uint32).astype(np.int64), np.frombuffer(times, np.uint32)
    code = np.repeat(np.frombuffer(b"".join(rows[~own].sort_values("part")["payload"]), np.uint8), times)
    return head, sizes, np.frombuffer(owner, np.uint16 if len(sizes) <= 1 << 16 else np.uint32).astype(np.int64), code, np.repeat(np.frombuffer(tokens, np.uint64), times) if tokens else np.zeros(0, np.uint64)


def _shared_counts(rows: pd.DataFrame) -> pd.DataFrame:
    """Of each distinct set of a block: digest, tokens, tokens that other sets hold too, ids of its documents."""
    (known, ids, which, digests), n, owner, code, _ = _answered(rows)
    shared = np.bincount(owner[code > 0], minlength=len(n))
    members: list[list[int | None]] = [[] for _ in n]
    for k, i, w in zip(known, np.frombuffer(ids, np.int64).tolist(), np.frombuffer(which, np.uint32).tolist(), strict=True):
        members[w].append(i if k else None)
    return pd.DataFrame({"digest": [digests[16 * k : 16 * k + 16] for k in range(len(n))], "n": n, "shared": shared, "ids": members})


def _prefixes(percent: int):
    """Each set's prefix under every order, without the tokens that it alone holds."""

    def prefixes(rows: pd.DataFrame) -> pd.DataFrame:
        (dids,), n, owner, code, token = _answered(rows)
        dids = np.frombuffer(dids, np.int64)
        token, owner, kind = token[code > 0], owner[code > 0], code[code > 0]
        shared = np.bincount(owner, minlength=len(n))
        take = (n - least_shared(n, percent) + 1) - (n - shared)
        starts = np.concatenate([[0], np.cumsum(shared)])
        sorted_ = [token[np.lexsort((mixed(token, s + 1), kind, owner))] for s in range(1 + MORE_ORDERS)]
        out = {"did": [], "n": [], "own": [], **{f"p{s}": [] for s in range(1 + MORE_ORDERS)}}
        for k in np.flatnonzero(take > 0):
            out["did"].append(int(dids[k]))
            out["n"].append(int(n[k]))
            out["own"].append(int(n[k] - shared[k]))
            for s in range(1 + MORE_ORDERS):
                out[f"p{s}"].append(sorted_[s][starts[k] : starts[k] + take[k]].view(np.int64))
        return pd.DataFrame({name: pd.Series(values, dtype=object if name.startswith("p") else np.int64) for name, values in out.items()})

    return prefixes


def _verify(percent: int):
    """Of candidate pairs with both sides' sets, whether they are linked."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch["set_a"], batch["set_b"], strict=True)]
            yield batch[["a", "b"]].assign(linked=np.array(keep, bool))

    return verify


def _send_docs(words: int, bits: int):
    """Documents as blocks; a block's number depends on its task's input alone."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, most = TaskContext.get().partitionId() << 24, max(BLOCK_TOKENS, 16 << bits)
        sets: dict[bytes, tuple[int, np.ndarray]] = {}
        docs: list[tuple[bool, int, int]] = []
        n = 0

        def blocked() -> pd.DataFrame:
            head = [bytes(k for k, _, _ in docs), np.array([i for _, i, _ in docs], np.int64).tobytes(), np.array([w for _, _, w in docs], np.uint32).tobytes(), b"".join(sets)]
            return _send(head, [tokens for _, tokens in sets.values()], block, bits)

        for batch in batches:
            for id_, known, text in zip(batch["id"].fillna("0"), batch["id"].notna(), batch["text"], strict=True):
                tokens = shingles(text, words)
                digest = hashlib.md5(tokens.tobytes(), usedforsecurity=False).digest()
                n += 1 if digest in sets else len(tokens) + 1
                docs.append((known, int(id_), sets.setdefault(digest, (len(sets), tokens))[0]))
                if n >= most:
                    yield blocked()
                    sets, docs, n, block = {}, [], 0, block + 1
        if docs:
            yield blocked()

    return send


def _send_sets(bits: int):
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, most = TaskContext.get().partitionId() << 24, max(BLOCK_TOKENS, 16 << bits)
        dids: list[int] = []
        sets: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for did, tokens in zip(batch["did"], batch["tokens"], strict=True):
                dids.append(int(did))
                sets.append(np.frombuffer(tokens, np.uint64))
                n += len(sets[-1])
                if n >= most:
                    yield _send([np.array(dids, np.int64).tobytes()], sets, block, bits, True)
                    dids, sets, n, block = [], [], 0, block + 1
        if sets:
            yield _send([np.array(dids, np.int64).tobytes()], sets, block, bits, True)

    return send


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, rounds: int = ROUNDS, hot: int = HOT) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links)."""
    spark = docs.sparkSession
    # Ids travel as text, since pandas would make numbers with nulls among them inexact.
    named = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    bits = min(16, max(4, (4 * partitions(spark) - 1).bit_length()))
    counted = _exchange(named.mapInPandas(tidy(_send_docs(words, bits)), SENT))
    every = written(counted.groupBy("block").applyInPandas(_shared_counts, "digest binary, n long, shared long, ids array<long>"), "ngram-counts")
    left = every.where((F.col("n") > 0) & (F.col("shared") * 100 >= F.col("n") * percent))
    one_each = left.groupBy("digest").agg(F.first("n").alias("n"), F.min(F.array_min("ids")).alias("id"))
    sets = written(one_each.withColumn("did", F.monotonically_increasing_id()), "ngram-sets")

    # The sets themselves, from the texts again, for those that are left only.
    def make_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [shingles(t, words).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"digest": [hashlib.md5(m, usedforsecurity=False).digest() for m in made], "tokens": made})

    ids = sets.select(F.col("id").cast("string").alias("id_")).distinct()
    ids = F.broadcast(ids) if sets.count() <= BROADCAST_IDS else ids
    texts = named.join(ids, F.col("id").eqNullSafe(F.col("id_")), "left_semi")
    again = texts.select("text").mapInPandas(tidy(make_sets), "digest binary, tokens binary").join(sets, "digest")
    whole = written(again.groupBy("did").agg(F.first("tokens").alias("tokens")), "ngram-tokens")

    shape = "did long, n long, own long, " + ", ".join(f"p{s} array<long>" for s in range(1 + MORE_ORDERS))
    prefixed = written(_exchange(whole.mapInPandas(tidy(_send_sets(bits)), SENT)).groupBy("block").applyInPandas(_prefixes(percent), shape), "ngram-prefixes")
    lists = _lists(prefixed, hot)
    orders = range(1, 1 + MORE_ORDERS)
    others = lambda letter: prefixed.select(F.col("did").alias(letter), *[F.col(f"p{s}").alias(f"{letter}{s}") for s in orders])
    sets_of = lambda letter: whole.select(F.col("did").alias(letter), F.col("tokens").alias(f"set_{letter}"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs that share a prefix token under all other orders too, and whether they are linked."""
        both = pairs.join(others("a"), "a").join(others("b"), "b")
        for s in orders:
            both = both.where(F.arrays_overlap(f"a{s}", f"b{s}"))
        both = both.select("a", "b").join(sets_of("a"), "a").join(sets_of("b"), "b")
        with few_records(spark, PAIRS):
            return written(both.mapInPandas(tidy(_verify(percent)), "a long, b long, linked boolean"), "ngram-verified")

    comps = written(lists.select("did").distinct().withColumn("comp", F.col("did")), "comps")
    done: list[DataFrame] = []
    last = rounds < 1
    while True:
        held = lists.join(comps, "did")
        pairs = _last_pairs(held, percent) if last else _round_pairs(held, percent, len(done))
        pairs = pairs.select(F.least("did", "did_c").alias("a"), F.greatest("did", "did_c").alias("b")).distinct()
        for earlier in done:
            pairs = pairs.join(earlier.select("a", "b"), ["a", "b"], "left_anti")
        found = verified(pairs)
        links = found.where("linked").select("a", "b")
        more = not links.isEmpty()
        if more:
            comps = merge_components(comps, links)
        done.append(found)
        if last:
            break
        last = not more or len(done) >= rounds
    remove_table(lists, prefixed, whole, *done)

    least = every.where("n > 0").groupBy("digest").agg(F.min(F.array_min("ids")).alias("least"))
    known = sets.select("digest", "did").join(comps, "did")
    of_comp = written(known.join(least, "digest").groupBy("comp").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "ngram-components")
    of_set = join_groups(known.select("comp", "digest"), of_comp, "comp", "members").select("digest", "component_id")
    classes = written(least.join(of_set, "digest", "left").select("digest", F.coalesce("component_id", "least").alias("component_id")), "ngram-classes")
    # A digest has at most one row per block here, its documents' ids in an array.
    in_class = every.where("n > 0").join(classes, "digest").select("ids", "n", "component_id")
    rows = in_class.unionByName(every.where("n = 0").select("ids", "n", F.lit(None).cast("long").alias("component_id")))
    told = rows.select(F.explode("ids").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    told = told.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col(id_col)).otherwise(F.col("component_id")))
    return finished(told, "ngram-result", every, sets, comps, of_comp, classes)


def _lists(prefixed: DataFrame, hot: int) -> DataFrame:
    """The inverted index: token, did, n, own, rest, salts and salt of all tokens that stand in several prefixes of the first order."""
    listed = prefixed.select("did", "n", "own", F.posexplode("p0").alias("at", "token")).withColumn("rest", F.col("n") - F.col("own") - F.col("at"))
    counted = written(listed.groupBy("token").count().where("count > 1"), "ngram-counted")
    most = max(hot, (counted.agg(F.sum("count")).first()[0] or 0) // MOST_HOT)
    salted = F.broadcast(counted.where(F.col("count") > most).select("token", F.ceil(F.col("count") / most).cast("int").alias("salts")))  # at most MOST_HOT rows
    salts = F.coalesce("salts", F.lit(1))
    places = counted.select("token").join(salted, "token", "left").select("token", _every_salt(salts))
    listed = listed.join(salted, "token", "left").withColumn("salts", salts).withColumn("salt", F.pmod(F.xxhash64("did"), F.col("salts")).cast("int"))
    lists = written(listed.join(places, ["token", "salt"], "left_semi").drop("at"), "ngram-lists")
    remove_table(counted)
    return lists


def _every_salt(salts):
    return F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")


def _enough(percent: int):
    """The shared token being the first one, at most the smaller rest of the two sets is shared."""
    return (100 + percent) * F.least("rest_a", "rest_b") >= percent * (F.col("n_a") + F.col("n_b"))


def _round_pairs(held: DataFrame, percent: int, turn: int) -> DataFrame:
    """In each list one member of every component, rather one with few tokens of its own, and the first of these, which the others are compared with."""
    lot = F.pmod(F.xxhash64("did", F.lit(turn)), F.lit(1024)) / F.lit(1024.0)
    member = F.struct((F.col("own") / F.col("n") * (1 + turn * lot)).alias("h"), "did", "n", "rest")
    offered = held.groupBy("token", "salts", "comp").agg(F.min(member).alias("m")).select("token", "salts", "comp", "m.*")
    middle = offered.groupBy("token", "salts").agg(F.min(F.struct("h", "did", "n", "rest", "comp")).alias("c"))
    middle = middle.select("token", _every_salt(F.col("salts")), F.col("c.did").alias("did_c"), F.col("c.n").alias("n_b"), F.col("c.rest").alias("rest_b"), F.col("c.comp").alias("comp_c"))
    asked = offered.select("token", F.pmod(F.xxhash64("comp"), F.col("salts")).cast("int").alias("salt"), "comp", "did", F.col("n").alias("n_a"), F.col("rest").alias("rest_a"))
    return asked.join(middle, ["token", "salt"]).where(_enough(percent) & (F.col("comp") != F.col("comp_c")))


def _last_pairs(held: DataFrame, percent: int) -> DataFrame:
    """Whatever is left: in lists that hold several components, each member outside the largest one with all others of about its size."""
    each = held.groupBy("token", "salts", "comp").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least"))
    several = each.groupBy("token", "salts").agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", "members").alias("main"), F.min("least").alias("least")).where("comps > 1")
    able = held.join(several.select("token", "main", "least", _every_salt(F.col("salts"))), ["token", "salt"]).where((100 + percent) * F.col("rest") >= percent * (F.col("n") + F.col("least")))
    # Linked sets differ in size by a factor of 100 / percent at most, so by one class at most.
    size = F.floor(F.log(F.col("n")) / F.log(F.lit(100.0 / min(percent, 99))) * 0.9999)
    odd = able.where("comp <> main").select("token", "salt", "did", F.col("n").alias("n_a"), F.col("rest").alias("rest_a"), "comp", F.explode(F.array(size - 1, size, size + 1)).alias("size"))
    each_salt = able.select("token", _every_salt(F.col("salts")), F.col("did").alias("did_c"), F.col("n").alias("n_b"), F.col("rest").alias("rest_b"), F.col("comp").alias("comp_c"), size.alias("size"))
    return odd.join(each_salt, ["token", "salt", "size"]).where(_enough(percent) & (F.col("comp") != F.col("comp_c")))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are the smallest id of their class; all rows without words stay.

    Null ids are larger than all others.  Where ids are null or repeat, rows are told apart
    by their locator (file and row within the file), which also decides between equal ids."""
    id_ = F.col(id_col).cast("long")
    if docs.groupBy(id_.alias("id")).count().where("id IS NULL OR count > 1").isEmpty():
        classes = near_duplicates(docs, id_col, text_col)
        gone = classes.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone"))
        return docs.join(gone, id_ == F.col("__gone"), "left_anti")
    rows = with_locator(docs, "ngram-input", "__file", "__row")
    files = sorted(r[0] for r in rows.select("__file").distinct().collect())
    numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), "__nth long, __file string")
    rows = rows.join(F.broadcast(numbers), "__file").withColumn("__uid", F.shiftleft("__nth", 40) + F.col("__row"))
    classes = near_duplicates(rows.select("__uid", F.col(text_col).alias("text")), "__uid").where("n_shingles > 0")
    ids = rows.select("__uid", F.struct(id_.isNull().alias("no_id"), id_.alias("id"), "__uid").alias("__place"))
    placed = classes.join(ids, "__uid").select("component_id", "__place")
    first = placed.groupBy("component_id").agg(F.min("__place").alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1")
    gone = placed.join(first, "component_id").where("__place.__uid <> first.__uid").select(F.col("__place.__uid").alias("__gone"))
    return rows.join(gone, F.col("__uid") == F.col("__gone"), "left_anti").select(*docs.columns)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:least(i + 4, len(w))], ' ') AS g
  FROM w, LATERAL (SELECT unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(2, len(w) - 3) END)) AS i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS component_id
FROM documents AS d LEFT JOIN n ON n.doc_id = d.doc_id
"""
