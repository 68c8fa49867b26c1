"""Best-fit packing of tokenized documents into sequences, by hierarchical residual packing.

Documents are tokenized whole, closed by an end id and cut only where they are longer
than a sequence.  Pieces are dealt to nodes by a hash; each node packs its pieces by
best fit, longest first, and seals the bins that are nearly full.  The others become
items of a parent node, which takes in ``FAN`` nodes and packs again, up to a root.

A node hands on ``fan`` bins of each fill for each level above it, which is exact: best fit leaves
a node at most one bin that is no more than half full, and two bins can only merge if one of them is such a bin.  So a
parent merges at most ``fan`` times, and of equally full bins it makes no difference which one is taken.
What is handed on is thus bounded by the length of a sequence, whatever the size of the input.

Tokenizing runs word by word (white space always ends a token of this vocabulary's
pre-tokenizer) through a cache of the ids of words seen before, which is emptied when a task ends.

Defined results: a null text counts as empty, its piece holds the end id alone;
null and repeated ids pass through; an empty table gives no rows; other columns are
ignored.  A very long text is tokenized whole, in one task.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from seqloom.llm.common import cache_cleared_by, finished, remove_table, slices, tidy, written

LENGTH, END_ID = 2048, 0
PIECES_PER_NODE, FAN = 20_000, 8
#: A bin with at most so many free places is sealed.
SLACK = 16
#: Words whose ids a worker remembers at once: so many new ones, and as many from before (about 200 bytes each).
CACHED = 350_000

# White space that the word split below may not treat as such.
_ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_PLAIN = re.compile("[ \t\n\r]+")
# Letters that NFC leaves alone and that have one lower-case form.
_LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, range(0xC0, 0xDF))).replace("\xd7", "") + "ßÿ"
_SIMPLE = re.compile(f"([{_LATIN}{_LATIN.lower()}]*)([.,;:!?]*)")
_tokenizers: dict[str, WordCache] = {}


class _Remembered(dict):
    """Values made when first asked for.  When there are too many, those not asked for since the last time are forgotten."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHED:
            self.older = dict(self)
            self.clear()
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.older = {}


class WordCache:
    """A tokenizer file, applied word by word; ids are little-endian unsigned 32-bit numbers.

    Words of Latin letters and a mark or two, nearly all there are, go to the model
    itself, letters and marks apart, as the file's normalizer and pre-tokenizer would
    hand them on; any other word takes the whole way."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in _LATIN.lower()}
        self.known = _Remembered(self._ids)

    def _ids(self, word: str) -> bytes:
        if not word:  # the split of odd texts gives one at an end that is white space
            return b""
        if word.isascii():
            if word.isalpha():
                if not word.islower():
                    return self.known[word.lower()]
                return array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()
            if word[-1] in ".,;:!?" and word[:-1].isalpha():
                return self.known[word[:-1].lower()] + self.known[word[-1]]
        simple = _SIMPLE.fullmatch(word)
        if not simple or not simple[1]:
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        letters, marks = simple.groups()
        if marks or not word.islower():
            return self.known[letters.lower()] + (self.known[marks] if marks else b"")
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word.translate(self.letters))]).tobytes()

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, _PLAIN.split(text) if _ODD.search(text) else text.split()))


@cache_cleared_by
def _forget() -> None:
    for cache in _tokenizers.values():
        cache.known.forget()


def word_cache(path: str) -> WordCache:
    if path not in _tokenizers:
        _tokenizers[path] = WordCache(path)
    return _tokenizers[path]


def _pieces(path: str, length: int, end_id: int):
    end = array("I", [end_id]).tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = word_cache(path)
        for batch in slices(batches):
            rows = []
            for uid, doc, text in zip(batch["uid"], batch["id"], batch["text"], strict=True):
                ids = cache.ids(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((uid, doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["uid", "id", "piece", "start", "length", "ids_crc32"])
            out["id"] = out["id"].astype(batch["id"].dtype)
            yield out

    return cut


def best_fit(sizes: list[int], length: int) -> tuple[list[int], list[int], list[int]]:
    """Packs sizes, longest first, each into the fullest bin that has room: (bin of each, offset of each, sizes of bins)."""
    bins, offsets, filled = [0] * len(sizes), [0] * len(sizes), []
    free: list[list[int]] = [[] for _ in range(length + 1)]
    open_ = 0  # bit r is set if a bin has r places free
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size = sizes[k]
        fits = open_ >> size
        if fits:
            room = size + ((fits & -fits).bit_length() - 1)
            at = free[room].pop()
            if not free[room]:
                open_ ^= 1 << room
        else:
            room, at = length, len(filled)
            filled.append(0)
        bins[k], offsets[k] = at, length - room
        filled[at] = length - room + size
        if room > size:
            free[room - size].append(at)
            open_ |= 1 << (room - size)
    return bins, offsets, filled


def _packer(level: int, length: int):
    """Packs the rows of a node.  A bin of pieces is numbered by its node and place, a merged one is named by its largest bin."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "item", "part"], kind="stable").reset_index(drop=True)
        bins, offsets, filled = best_fit(rows["length"].tolist(), length)
        if not level:
            base = int(rows["node"].iloc[0]) << 24
            return rows.assign(bin=[base + b for b in bins], offset=offsets)
        first = {b: item for b, o, item in zip(bins, offsets, rows["item"].tolist(), strict=True) if not o}
        return rows.assign(bin=[first[b] for b in bins], offset=offsets)

    return pack


def packed(pieces: DataFrame, length: int = LENGTH, pieces_per_node: int = PIECES_PER_NODE, fan: int = FAN, slack: int = SLACK, handed_on: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to rows that have uid, piece and length.  ``handed_on``: bins of each fill that a node hands on, if not ``fan`` for each level."""
    count, nodes, levels = pieces.count(), 1, 0
    while nodes * pieces_per_node < count:
        nodes, levels = nodes * fan, levels + 1
    handed_on = handed_on or fan * levels
    others = [c for c in pieces.columns if c not in ("uid", "piece", "length")]
    rest = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    items = pieces.select(F.pmod(F.xxhash64("uid", "piece"), F.lit(nodes)).alias("node"), F.col("uid").alias("item"), F.col("piece").cast("long").alias("part"), F.col("length").cast("int").alias("length"), rest.alias("rest"))
    out = "node long, item long, part long, length int, rest {}, bin long, offset int"
    placed = written(items.groupBy("node").applyInPandas(_packer(0, length), out.format(items.schema["rest"].dataType.simpleString())), "pack-pieces")
    # Bins that may still merge, and where bins went that did: bin, root, further.
    open_ = placed.groupBy("bin", "node").agg(F.sum("length").cast("int").alias("length"))
    moves: DataFrame | None = None
    alike = Window.partitionBy("node", "length").orderBy("bin")
    for level in range(1, levels + 1):
        few = open_.where(F.col("length") < length - slack).withColumn("nth", F.row_number().over(alike)).where(F.col("nth") <= handed_on)
        items = few.select(F.floor(F.col("node") / fan).alias("node"), F.col("bin").alias("item"), F.lit(0).cast("long").alias("part"), "length", F.struct(F.lit(0).alias("none")).alias("rest"))
        merged = written(items.groupBy("node").applyInPandas(_packer(level, length), out.format("struct<none:int>")), "pack-merged")
        new = merged.where("item <> bin").select(F.col("item").alias("root"), F.col("bin").alias("parent"), F.col("offset").alias("further"))
        own = new.select(F.col("root").alias("bin"), F.col("parent").alias("root"), F.col("further").alias("shift"))
        if moves is not None:
            on = moves.join(new, "root", "left").select("bin", F.coalesce("parent", "root").alias("root"), (F.col("shift") + F.coalesce("further", F.lit(0))).alias("shift"))
            own = on.unionByName(own)
        before, moves, old = moves, written(own, "pack-moves"), open_
        open_ = written(merged.groupBy("bin", "node").agg(F.sum("length").cast("int").alias("length")), "pack-open")
        remove_table(before, merged, old)
    remove_table(open_)
    if moves is not None:
        rows = placed.join(moves, "bin", "left").withColumns({"bin": F.coalesce("root", "bin"), "offset": F.col("offset") + F.coalesce("shift", F.lit(0))})
    else:
        rows = placed
    told = rows.select(
        F.col("item").alias("uid"), F.col("part").cast("int").alias("piece"), F.col("length").cast("long").alias("length"), *([f"rest.{c}" for c in others]),
        F.col("bin").alias("sequence_id"), F.col("offset").cast("long").alias("offset"),
    )
    return finished(told, "pack-result", placed, moves)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, **packing: int) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.  ``tokenizer`` is a file that every executor has."""
    named = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = f"uid long, id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    pieces = written(named.mapInPandas(tidy(_pieces(tokenizer, length, end_id)), out), "pack-tokens")
    rows = packed(pieces, length, **packing)
    remove_table(pieces)
    return rows.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def word_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_tokenizer())
