"""Conversation repair: the cheapest edits that give the roles ``(system? (user assistant)+)?``, by search from both ends.

A row's first fault counts: blank (nothing but ``[\\x20\\x09-\\x0D]``), duplicate (role and text seen earlier in its conversation), truncated
(its last other character is none of ``.!?``). Roles count by their first letters s, u and a. The edits, by their letters
in the audit:

* K keeps a row (0, and 3 if truncated), R makes it a user's or an assistant's turn (3, and 3 if truncated).
* D deletes it (4); blank rows and duplicates must go.
* I inserts a user's or an assistant's turn with an empty text (3).

Of the cheapest audits the least in ASCII order is taken. It decides the roles, as only one role fits after each turn.

The edit lattice has a node for each number of rows done and each state (nothing yet, after s, after u, after a).
Two heaps hold its forward and reverse frontiers, in order of cost, rows done and audit so far. The side with the cheaper
frontier moves on; a step to a node that the other side has settled is a crossing. The search ends when the two
frontiers together cost more than the best crossing, so all crossings of equal cost are seen, and the least
concatenated audit is taken. Of two audits to a node that cost the same none begins with the other (rows done and state
tell how many turns were inserted), so the least one stays the least whatever follows.

* Rows stand in order of conversation, turn (nulls first), role and text by range partitions (``places.in_order``). Each run of ``RUN`` rows of
  that order is a piece, in which a row is a letter or two. A conversation inside a piece is searched there; one that
  reaches beyond is searched in each piece from each state to each, and the pieces' results are multiplied up. What meets in one place
  for a conversation is an audit, which its result row has anyhow.
* Repaired texts aren't gathered: rows and audits are sorted by conversation and stream through a SHA-256. A digest is made byte after
  byte, so a conversation's last pass is one task, with one Arrow batch in memory.

Null roles and texts count as one blank. A null conversation id is a conversation. Repeated rows are duplicates of each other.
Conversations whose rows are all dropped stay with zeros, an empty audit and the digest of nothing. A table without rows
gives none. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from spotweave.llm import common
from spotweave.operators import places

#: What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a piece (a power of two).
RUN = 256
#: States: nothing yet, after s, after u, after a; where a conversation may end; what a turn of u or a makes of each.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ENDS = (START, AFTER_A)
NEXT = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
KEPT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
ROLES = {AFTER_U: "user", AFTER_A: "assistant"}
LEGAL = {"su", "ua", "au"}
SPACES = " \t\n\x0b\f\r"

Row = tuple[str, str]  # first letter of the role, and the fault: b, d, t or none


def steps(row: Row, state: int) -> Iterator[tuple[int, int, str]]:
    """(state, cost, letter) of the edits that do a row."""
    initial, fault = row
    yield state, DELETE, "D"
    if fault not in ("b", "d"):
        more = TRUNCATED if fault == "t" else 0
        if (state, initial) in KEPT:
            yield KEPT[state, initial], more, "K"
        yield NEXT[state], REROLE + more, "R"


def least_edits(rows: list[Row], entry: int = START, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """The cost and the audit from state ``entry`` before the rows to one of ``ends`` after them."""
    n = len(rows)
    into: list[dict[int, list[tuple[int, int, str]]]] = []  # for each row, by state after it
    for row in rows:
        back: dict[int, list[tuple[int, int, str]]] = {}
        for state in range(4):
            for after, cost, letter in steps(row, state):
                back.setdefault(after, []).append((state, cost, letter))
        into.append(back)
    inserted = {AFTER_U: (START, AFTER_S, AFTER_A), AFTER_A: (AFTER_U,)}
    ahead: dict[tuple[int, int], tuple[int, str]] = {}
    behind: dict[tuple[int, int], tuple[int, str]] = {}
    forward, reverse = [(0, 0, "", entry)], [(0, 0, "", q) for q in ends]
    best: tuple[int, str] | None = None
    while forward and reverse and (best is None or forward[0][0] + reverse[0][0] <= best[0]):
        if forward[0][0] <= reverse[0][0]:
            cost, at, audit, state = heapq.heappop(forward)
            if (at, state) in ahead:
                continue
            ahead[at, state] = cost, audit
            edges = [(at, NEXT[state], INSERT, "I")]
            if at < n:
                edges += [(at + 1, *step) for step in steps(rows[at], state)]
            crossing = [(cost, audit, (at, state))] + [(cost + c, audit + letter, (k, q)) for k, q, c, letter in edges]
            for k, q, c, letter in edges:
                if (k, q) not in ahead:
                    heapq.heappush(forward, (cost + c, k, audit + letter, q))
            for c, prefix, node in crossing:
                if node in behind:
                    met = (c + behind[node][0], prefix + behind[node][1])
                    best = met if best is None else min(best, met)
        else:
            cost, done, audit, state = heapq.heappop(reverse)
            at = n - done
            if (at, state) in behind:
                continue
            behind[at, state] = cost, audit
            edges = [(at, q, INSERT, "I") for q in inserted.get(state, ())]
            if at:
                edges += [(at - 1, *step) for step in into[at - 1].get(state, ())]
            crossing = [(cost, audit, (at, state))] + [(cost + c, letter + audit, (k, q)) for k, q, c, letter in edges]
            for k, q, c, letter in edges:
                if (k, q) not in behind:
                    heapq.heappush(reverse, (cost + c, n - k, letter + audit, q))
            for c, suffix, node in crossing:
                if node in ahead:
                    met = (c + ahead[node][0], ahead[node][1] + suffix)
                    best = met if best is None else min(best, met)
    return best


Ways = dict[tuple[int, int], tuple[int, str]]  # from state to state


def ways_through(rows: list[Row]) -> Ways:
    """The least edits of a piece from each state to each."""
    found = {(p, q): least_edits(rows, p, (q,)) for p in range(4) for q in range(4)}
    return {k: v for k, v in found.items() if v is not None}


def multiplied(a: Ways, b: Ways) -> Ways:
    """The least edits through one piece and the next."""
    out: Ways = {}
    for (p, m), (cost, audit) in a.items():
        for (k, q), (c, rest) in b.items():
            if k == m and (out.get((p, q)) is None or (cost + c, audit + rest) < out[p, q]):
                out[p, q] = cost + c, audit + rest
    return out


def product(pieces: list[Ways]) -> Ways:
    """All pieces in order, multiplied two and two."""
    while len(pieces) > 1:
        pieces = [multiplied(*pieces[k : k + 2]) if k + 1 < len(pieces) else pieces[k] for k in range(0, len(pieces), 2)]
    return pieces[0]


# --- the rows -----------------------------------------------------------------------------------------------


def trimmed(text: Column) -> Column:
    """The text without the blanks at its end."""
    return F.rtrim(text, F.lit(SPACES))


def ordered_rows(turns: DataFrame) -> DataFrame:
    """The rows (``key``, ``conv``, ``turn``, ``role``, ``text``; ``gone``: counts for the conversation only) in order, with what the search needs."""
    end = trimmed(F.col("text"))
    fault = F.when(end == "", "b").when(F.substring(end, -1, 1).isin(".", "!", "?"), "").otherwise("t")
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    facts = turns.select("*", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), same.alias("same"))
    return places.in_order(facts, ["key", "turn", "role", "text", "gone"])


def _pieces(rows: DataFrame) -> DataFrame:
    """A row for each conversation and run of the order, its rows' facts by place; ``whole`` if no other run can have more of it."""
    live = rows.where(~F.col("gone") & (F.col("fault") != "b"))
    salt = F.xxhash64("_at")
    seen = common.written(common.salted_min(live.select("key", "same", "_at"), ["key", "same"], "_at", "first", salt).drop("_n"))
    facts = rows.select("key", "turn", "gone", "initial", "fault", "same", "_at", F.pmod(salt, F.lit(64)).alias("_salt"))
    judged = facts.join(seen, ["key", "same", "_salt"], "left").withColumn("fault", F.when((F.col("fault") != "b") & (F.col("_at") > F.col("first")), "d").otherwise(F.col("fault")))
    last = F.broadcast(common.written(rows.groupBy(F.shiftright("_at", places.WITHIN).alias("range")).agg(F.max("_at").alias("last"))))  # a row for each task that wrote rows
    items = F.array_sort(F.collect_list(F.struct("_at", "turn", "gone", "initial", "fault"))).alias("items")
    runs = judged.groupBy("key", F.expr(f"_at div {RUN}").alias("run")).agg(items, F.min("_at").alias("a"), F.max("_at").alias("b"))
    inside = (F.col("a") % RUN != 0) & (F.col("b") % RUN != RUN - 1) & (F.col("b") < F.col("last"))
    return runs.join(last, F.shiftright("b", places.WITHIN) == F.col("range")).select("key", "run", "items", inside.alias("whole"))


#: What is known of a piece or of a conversation: counts, its ends, and least edits from state (p) to state (q).
_SUMMARY = "n long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, ways array<struct<p:int,q:int,cost:long,audit:string>>"
_NAMES = [f.split()[0] for f in _SUMMARY.split(", ")]


def summary(items: list[dict], whole: bool) -> dict:
    live = [x for x in items if not x["gone"]]
    rows = [(x["initial"], x["fault"]) for x in live]
    faults = [f for _, f in rows]
    turns = sorted({x["turn"] for x in live if x["turn"] is not None})
    ways = ways_through(rows) if not whole else {(START, AFTER_A): least_edits(rows)}
    return {
        "n": len(rows), "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": sum(a + b not in LEGAL for (a, _), (b, _) in zip(rows[:-1], rows[1:], strict=True)),
        "first": rows[0][0] if rows else None, "last": rows[-1][0] if rows else None,
        "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(turns), "ways": ways,
    }


def joined(parts: list[dict]) -> dict:
    """The summary of a conversation from those of its pieces in order."""
    out = {k: sum(x[k] for x in parts) for k in ("n", "blank", "duplicate", "truncated", "illegal", "turns")}
    live = [x for x in parts if x["n"]]
    out["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(live[:-1], live[1:], strict=True))
    known = [x for x in parts if x["turns"]]
    out["turns"] -= sum(a["high"] == b["low"] for a, b in zip(known[:-1], known[1:], strict=True))
    out |= {"low": known[0]["low"] if known else None, "high": known[-1]["high"] if known else None}
    ways = product([x["ways"] for x in parts])
    return out | {"ways": {(START, AFTER_A): min(v for (p, q), v in ways.items() if p == START and q in ENDS)}}


def conversations(rows: DataFrame) -> DataFrame:
    """``key`` with the counts, ``cost`` and ``audit`` of each conversation."""
    common.small_batches(rows.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                found = summary(r["items"], r["whole"])
                found["ways"] = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in found["ways"].items()]
                out.append({"key": r["key"], "run": r["run"]} | found)
            yield pa.RecordBatch.from_pylist(out, schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                parts = [x | {"ways": {(w["p"], w["q"]): (w["cost"], w["audit"]) for w in x["ways"]}} for x in r["parts"]]
                found = joined(parts) if len(parts) > 1 else parts[0]
                cost, audit = min(v for (p, q), v in found["ways"].items() if p == START and q in ENDS)
                gaps = found["high"] - found["low"] + 1 - found["turns"] if found["turns"] else 0
                out.append({"key": r["key"], "gaps": gaps, "cost": cost, "audit": audit} | {k: found[k] for k in ("blank", "duplicate", "truncated", "illegal")})
            yield pa.RecordBatch.from_pylist(out, results)

    schema = to_arrow_schema(StructType.fromDDL(f"key string, run long, {_SUMMARY}"))
    result = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    results = to_arrow_schema(StructType.fromDDL(result))
    pieces = _pieces(rows).mapInArrow(each, f"key string, run long, {_SUMMARY}")
    parts = pieces.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("run", *_NAMES))).alias("parts"))
    return common.written(parts.mapInArrow(whole, result))


class Repair:
    """Rows of a conversation, in order, under its audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START
        self.lines, self.digest = 0, hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.digest.update(("\n" * bool(self.lines) + role + ":").encode())
        self.digest.update(text.encode())
        self.lines += 1

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.state, self.at = NEXT[self.state], self.at + 1
            self._line(ROLES[self.state], "")

    def row(self, role: str, text: str) -> None:
        self._insert()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "K":
            self.state = KEPT[self.state, role[:1]]
            self._line(role, text)
        elif letter == "R":
            self.state = NEXT[self.state]
            self._line(ROLES[self.state], text)

    def end(self) -> str:
        self._insert()
        return self.digest.hexdigest()


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``key`` and ``repaired_sha256`` of each conversation."""
    heads = found.select("key", F.lit(-1).cast("long").alias("_at"), F.col("audit").alias("role"), F.lit(None).cast("string").alias("text"))
    both = heads.unionByName(rows.where(~F.col("gone")).select("key", "_at", "role", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["_at"] < 0:
                    if own is not None:
                        done.append((key, own.end()))
                    key, own = r["key"], Repair(r["role"])
                else:
                    own.row(r["role"], r["text"])
            yield _digests(done)
        if own is not None:
            yield _digests([(key, own.end())])

    return both.repartition("key").sortWithinPartitions("key", "_at").mapInArrow(run, "key string, repaired_sha256 string")


def _digests(done: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([d for _, d in done], pa.string())], names=["key", "repaired_sha256"])


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: Column | None = None) -> DataFrame:
    """``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and ``repaired_sha256`` of each conversation.

    Rows where ``gone`` is true count for nothing but that their conversation has a result.
    """
    one = F.lit(" ")
    key = F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit("null"))
    own = turns.select(key.alias("key"), F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), one).alias("role"), F.coalesce(F.col(text).cast("string"), one).alias("text"), F.coalesce(gone if gone is not None else F.lit(False), F.lit(False)).alias("gone"))
    with common.passing(turns.sparkSession):
        rows = ordered_rows(own)
        found = conversations(rows)
        ids = rows.groupBy("key").agg(F.first("conv").alias("conv_id"))
        out = ids.join(found, "key").join(repaired(rows, found), "key")
        return common.written(out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"), keep=True)


def damaged(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows (``conv_id``, ``turn``, ``role``, ``text``, ``gone``) after damage by the crc32 of ``conv_id:turn``, modulo 20.

    0 drops a row (``gone``), 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats it, 4 makes it a user's. Nulls are one blank.
    """
    one = F.lit(" ")
    part = lambda c: F.coalesce(F.col(c).cast("string"), one)
    fate = F.crc32(F.concat(part(conv_id), F.lit(":"), part(turn)).cast("binary")) % 20
    hit = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), part(role).alias("role"), part(text).alias("text"), fate.alias("fate"))
    texts = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = hit.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), texts.alias("text"), (F.col("fate") == 0).alias("gone"), F.when(F.col("fate") == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", "gone", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("col")
