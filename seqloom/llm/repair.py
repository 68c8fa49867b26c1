"""Repair of the structure of conversations by a dynamic program over the turns that are retained.

A conversation shall have the role initials ``(s?(ua)+)?``.  Turns are kept (0) or reroled to user or
assistant (1); what lies between two retained turns is deleted (2 each) and the pair of their roles
determines how many empty turns must be inserted (5 each).  Deletions are priced by prefix sums: costs are
kept less 2 for each turn so far, so that the best of all turns that a gap may begin with is a running minimum for each
role, and a turn looks at four minima instead of at all turns before it.  Blank turns and duplicates
must be deleted; truncated turns cost 5 more if they stay.  Of equally cheap edits the audit that is least in ASCII
wins.  Audits are not compared letter by letter: two of the same number of turns are never a prefix of each
other, as inserts are written with the turn that follows them, so the order of two audits follows
from the order before the last turn and from what this one adds.

A conversation may be longer than a task can hold.  Turns are dealt by ranges of (conversation, turn) and written
in order; a task runs the program over its part of a conversation.  For the part with which a task's range begins, it does so
from each of the four roles that what lies before may end with, which gives a matrix of costs and of the order of the audits; the few
parts of a conversation are then joined by (min, +) products, in order, and each part is run once more from the role that won
and tells what becomes of each of its turns.  Last, the turns of a conversation are read in
order, one at a time, to hash what is left and to spell the audit; only the audit, a value of the result, grows with the conversation.
First occurrences come from a grouping by conversation and digest of role and text and are joined by place, which is
unique: a turn repeated very often is no task's group.

Defined results: null roles and texts are one space, as are null ids in the string whose checksum decides on the damage;
null conversations are one; null turns come first; equal turns are ordered by role, the first 32 letters of the text and
a digest of the whole; repeats follow their original; a role's initial is its first letter, whatever it is; very long texts are hashed one
at a time; gaps that no long can hold are 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import few_records, finished, partitions, remove_table, tidy, written

#: Costs of the contract.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Roles that the last retained turn may have; the first is none so far.
STATES = ("", "s", "u", "a")
#: Inserts between two retained roles, where the second may follow at all, and after the last one.
BETWEEN = {("", "s"): 0, **{(p, "u"): int(p == "u") for p in STATES}, **{(p, "a"): int(p != "u") for p in STATES}}
AFTER = {"": 0, "s": 2, "u": 1, "a": 0}
#: Faults: none, one that a turn must be deleted for, a truncated turn.
FINE, GONE, CUT = 0, 1, 2
#: Turns of a part whose result a worker remembers, and results that it remembers.
REMEMBERED_TURNS, REMEMBERED = 64, 1 << 14
#: White space of the contract.
BLANKS = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
SHAPE = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def choices(initial: str, fault: int) -> list[tuple[str, str, int]]:
    """(new role, edit, cost less that of deleting) of retaining a turn."""
    if fault == GONE:
        return []
    more = (TRUNCATED if fault == CUT else 0) - DELETE
    kept = [(initial, "K", more)] if initial in STATES[1:] else []
    return kept + [(r, "R", more + REROLE) for r in "ua" if r != initial]


#: From each role the least cost and the order of its audit; costs are less what deleting all turns so far costs.
Minima = dict[str, tuple[int, int]]


def advance(minima: list[Minima], turns: Iterable[tuple[str, int]]) -> tuple[list[Minima], list[list[dict]]]:
    """The minima after some turns, begun from several sides by side, and for each turn and begin where each came from: role -> (role before, edit, inserts)."""
    trail = []
    for initial, fault in turns:
        found, steps = [], []
        options = choices(initial, fault)
        for start in minima:
            best = {p: (cost, order, "D", p) for p, (cost, order) in start.items()}
            for role, edit, price in options:
                for p, (cost, order) in start.items():
                    if (p, role) in BETWEEN:
                        n = BETWEEN[p, role]
                        way = (cost + price + INSERT * n, order, "I" * n + edit, p)
                        if role not in best or way < best[role]:
                            best[role] = way
            found.append(best)
            steps.append({role: (p, text[-1], len(text) - 1) for role, (_, _, text, p) in best.items()})
        # The audits' order: by the order before, then by what this turn adds.
        ranks = {x: k for k, x in enumerate(sorted({(order, text) for best in found for _, order, text, _ in best.values()}))}
        minima = [{role: (cost, ranks[order, text]) for role, (cost, order, text, _) in best.items()} for best in found]
        trail.append(steps)
    return minima, trail


def begun(first: bool) -> list[Minima]:
    """One begin for the first part of a conversation, else one for each role before it."""
    return [{p: (0, 0)} for p in (STATES[:1] if first else STATES)]


@lru_cache(REMEMBERED)
def _remembered(first: bool, turns: tuple[tuple[str, int], ...]) -> list[Minima]:
    return advance(begun(first), turns)[0]


def part_minima(first: bool, turns: list[tuple[str, int]]) -> list[Minima]:
    return _remembered(first, tuple(turns)) if len(turns) <= REMEMBERED_TURNS else advance(begun(first), turns)[0]


def part_edits(turns: list[tuple[str, int]], begin: str, end: str) -> list[tuple[str, str, int]]:
    """(edit, role, inserts before) of each turn of a part that begins and ends with these roles."""
    _, trail = advance([{begin: (0, 0)}], turns)
    out = []
    for steps in reversed(trail):
        before, edit, n = steps[0][end]
        out.append((edit, end, n))
        end = before
    return out[::-1]


def chosen(parts: list[list[Minima]], turns: int) -> tuple[int, list[str]]:
    """The cost of a conversation and the roles that each part ends with, from its parts' minima."""
    now: Minima = {"": (0, 0)}
    back = []
    for part in parts:
        ways: dict[str, tuple] = {}
        for k, begin in enumerate(STATES[: len(part)]):
            if begin in now:
                cost, order = now[begin]
                for end, (more, within) in part[k].items():
                    ways[end] = min(ways.get(end, (float("inf"),)), (cost + more, order, within, begin))
        ranks = {x: k for k, x in enumerate(sorted({w[1:3] for w in ways.values()}))}
        now = {end: (w[0], ranks[w[1:3]]) for end, w in ways.items()}
        back.append({end: w[3] for end, w in ways.items()})
    cost, _, _, end = min((cost + INSERT * AFTER[p], order, "I" * AFTER[p], p) for p, (cost, order) in now.items())
    ends = [end]
    for step in reversed(back[1:]):
        ends.append(step[ends[-1]])
    return cost + DELETE * turns, ends[::-1]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy) after the damage that a checksum of each row's conversation and turn decides on."""
    blank = F.lit(" ")
    number = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    kind = F.crc32(F.concat(number("conv_id"), F.lit(":"), number("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    rows = rows.withColumn("kind", kind).where("kind <> 0")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def _segments(rows: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[tuple, list[tuple]]]:
    """(part, conversation) and its rows, of rows in order; a part of a conversation is held, a whole one is not."""
    key, held = None, []
    for batch in rows:
        part, conv = batch.column("part").to_pylist(), batch.column("conv_id").to_pylist()
        for now, row in zip(zip(part, conv, strict=True), zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
            if now != key:
                if held:
                    yield key, held
                key, held = now, []
            held.append(row)
    if held:
        yield key, held


PART = "part int, conv_id long, at long, turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string, costs array<int>, orders array<int>"
LEGAL = {"su", "ua", "au"}


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part's counts and its minima, as lists over begin and end; -1 where there is no way."""
    out: list[tuple] = []
    for (part, conv), rows in _segments(batches, "at", "initial", "fault", "new"):
        turns = [(i, FINE if f == "fine" and n else CUT if f == "truncated" and n else GONE) for _, i, f, n in rows]
        # The first conversation of a part may have begun before it.
        first = bool(rows[0][0] & ((1 << 33) - 1))
        minima = part_minima(first, turns)
        flat = [m.get(p, (None, -1)) for m in minima for p in STATES]
        faults = ["blank" if f == "blank" else "duplicate" if not n else f for _, _, f, n in rows]
        odd = sum(a[0] + b[0] not in LEGAL for a, b in zip(turns, turns[1:]))
        out.append((part, conv, rows[0][0], len(rows), *(faults.count(f) for f in ("blank", "duplicate", "truncated")), odd, turns[0][0], turns[-1][0], [c for c, _ in flat], [o for _, o in flat]))
        if len(out) >= 2000:
            yield _batch(out, PART)
            out = []
    if out:
        yield _batch(out, PART)


TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _batch(rows: list[tuple], shape: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in shape.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


CHOSEN = "part int, conv_id long, begin string, end string, blank long, duplicate long, truncated long, illegal long, cost long"


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the parts of a conversation, which come in order: the roles each begins and ends with; totals stand at the last part."""
    names = [f.split()[0] for f in PART.split(", ")]
    out, key, parts = [], None, []

    def solve() -> None:
        minima = [[{p: (c, o) for p, c, o in zip(STATES, r["costs"][k : k + 4], r["orders"][k : k + 4], strict=True) if c is not None} for k in range(0, len(r["costs"]), 4)] for r in parts]
        cost, ends = chosen(minima, sum(r["turns"] for r in parts))
        odd = sum(r["illegal"] for r in parts) + sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(parts, parts[1:]))
        sums = [sum(r[c] for r in parts) for c in ("blank", "duplicate", "truncated")]
        for r, begin, end in zip(parts, ["", *ends], ends, strict=False):
            out.append((r["part"], r["conv_id"], begin, end, *((*sums, odd, cost) if r is parts[-1] else (None,) * 5)))

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            r = dict(zip(names, row, strict=True))
            if parts and key != r["conv_id"]:
                solve()
                parts = []
            key = r["conv_id"]
            parts.append(r)
            if len(out) >= 2000:
                yield _batch(out, CHOSEN)
                out.clear()
    if parts:
        solve()
    if out:
        yield _batch(out, CHOSEN)


EDITS = "at long, edit string, becomes string, inserts int, closing int"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What becomes of each turn; at a conversation's last turn also how many are inserted after it."""
    out: list[tuple] = []
    for _, rows in _segments(batches, "at", "initial", "fault", "new", "begin", "end", "last"):
        turns = [(i, FINE if f == "fine" and n else CUT if f == "truncated" and n else GONE) for _, i, f, n, *_ in rows]
        begin, end, last = rows[0][4:]
        edits = part_edits(turns, begin, end)
        out += [(r[0], edit, role, n, 0) for r, (edit, role, n) in zip(rows, edits, strict=True)]
        if last:
            out[-1] = (*out[-1][:4], AFTER[end])
        if len(out) >= 5000:
            yield _batch(out, EDITS)
            out = []
    if out:
        yield _batch(out, EDITS)


SPELLED = "conv_id long, audit string, repaired_sha256 string"


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads turns in order and hashes what is left of each conversation."""
    out, key, digest, audit, begun_ = [], None, None, [], False

    def write(role: str, text: str) -> None:
        nonlocal begun_
        digest.update((("\n" if begun_ else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        begun_ = True

    last = ""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "edit", "becomes", "inserts", "closing")]
        for conv, role, text, edit, becomes, inserts, closing in zip(*columns, strict=True):
            if digest is None or key != conv:
                if digest is not None:
                    out.append((key, "".join(audit), digest.hexdigest()))
                key, digest, audit, begun_, last = conv, hashlib.sha256(), [], False, ""
            audit.append("D" if edit == "D" else "I" * inserts + edit)
            if edit != "D":
                if inserts:  # what the pair of roles lacks
                    write(ROLES["u" if becomes == "a" else "a"], "")
                write(role if edit == "K" else ROLES[becomes], text)
                last = becomes
            for _ in range(closing):
                last = "a" if last == "u" else "u"
                audit.append("I")
                write(ROLES[last], "")
        if len(out) >= 2000:
            yield _batch(out, SPELLED)
            out = []
    if digest is not None:
        out.append((key, "".join(audit), digest.hexdigest()))
    if out:
        yield _batch(out, SPELLED)


def repair(conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """A row for each conversation of a table (conv_id, turn, role, text) in whose rows damage is found and repaired.

    ``parts``: ranges that the turns are dealt to; as many as the session's shuffles have, if not given."""
    spark = conversations.sparkSession
    turns = damaged(conversations)
    found = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    fault = F.when(found == "", "blank").when(found.isin(".", "!", "?"), "fine").otherwise("truncated")
    digest = F.sha2(F.concat("role", F.lit("\0"), "text"), 256)
    turns = turns.withColumns({"initial": F.substring("role", 1, 1), "fault": fault, "digest": digest, "place": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", F.substring("text", 1, 32), "digest", "place"]
    dealt = turns.repartitionByRange(parts or partitions(spark), *order).sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", "turn", "role", "text", "initial", "fault", "digest", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    turns = written(dealt, "repair-turns")
    new = turns.groupBy("conv_id", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    light = turns.select("part", "conv_id", "at", "initial", "fault").join(new, "at", "left").withColumn("new", F.coalesce("new", F.lit(False)))
    light = written(light.repartition("part").sortWithinPartitions("part", "at"), "repair-light")
    ordered = light.repartition("part").sortWithinPartitions("part", "at")
    segments = ordered.select("part", "conv_id", "at", "initial", "fault", "new").mapInArrow(tidy(_parts), PART)
    decided = written(segments.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(tidy(_chosen), CHOSEN), "repair-parts")
    ways = decided.select(F.col("part").alias("p"), F.col("conv_id").alias("c"), "begin", "end", F.col("cost").isNotNull().alias("last"))
    told = light.join(ways, (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c"))).select(*light.columns, "begin", "end", "last")
    edits = told.repartition("part").sortWithinPartitions("part", "at").mapInArrow(tidy(_edits), EDITS)
    with few_records(spark, 500):
        spelled = turns.select("conv_id", "at", "role", "text").join(edits, "at").repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(tidy(_spelled), SPELLED)
        gaps = turns.groupBy("conv_id").agg(F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), 1 - F.count_distinct("turn")).alias("gaps"))
        names = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        sums = decided.where("cost IS NOT NULL").drop("part", "begin", "end")
        rows = names
        for more in (gaps, sums, spelled):
            more = more.withColumnRenamed("conv_id", "other")
            rows = rows.join(more, F.col("conv_id").eqNullSafe(F.col("other")), "left").drop("other")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
        numbers = [f.split()[0] for f in SHAPE.split(", ")[1:7]]
        rows = rows.select("conv_id", *map(zero, numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
        out = finished(rows, "repair-result", light, decided)
    remove_table(turns)
    return out


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
