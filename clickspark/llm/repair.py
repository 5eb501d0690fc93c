"""Conversation structure repair: the cheapest edits that make a conversation
alternate, found by depth-first branch-and-bound.

``faults`` looks at each turn in order: blank (nothing but white space),
duplicate (role and text seen earlier), truncated (does not end in ``. ! ?``).
``repairs`` chooses one edit per turn, and insertions between them, so that
the role initials read ``(s?(ua)+)?``: Keep 0, Rerole to user or assistant 1,
Delete 2 (a must for blank and duplicate turns), Insert an empty turn 5; a
truncated turn that stays adds 5.  Of the cheapest edit sequences the one
whose initials (D, I, K, R) come first in ASCII is the audit.  ``repaired``
applies the audits and gives the turns.

Search (``search``): nodes are (turn, state of the pattern).  A backward pass
gives for every node a lower bound on the cost of the suffix.  The search
keeps an explicit stack, goes first where cost plus bound is least (then by
letter), holds the best finished (cost, audit) as incumbent and, per node, the
best prefix seen; a prefix that the node's table dominates, or that with its
bound cannot beat the incumbent, is dropped.  It ends when the stack is empty,
so the incumbent is proved.  The order relies on no property of the bound but
that it never exceeds the true cost; the bound here is tight, so a
conversation takes a few steps per turn.

Scale: the search sees no texts, only (conversation, turn, role, digest of the
text) and flags.  Equal rows are counted before the shuffle; duplicates at
other turns come from a map-side combined minimum per digest, joined on the
digest.  Rows are range-partitioned by conversation and turn, so a
conversation that holds a third of all rows is spread over many tasks: each
stretch of at most ``STRETCH`` turns is solved for every pair of states at its
ends, and the few stretches are chained per conversation.  Texts are shuffled
once, to be edited in one pass over sorted rows; a task holds one audit (one
byte a turn) and one Arrow batch at a time.

Rows: turns are ordered by (turn, role, digest of the text), nulls first; null
role and text are one space (so the turn is blank, its role illegal); roles
count by their first character, an empty role like any illegal one; null
conv_ids form one conversation; repeated rows are repeated turns, hence
duplicates; very long texts are digested whole; extra columns are ignored; an
empty table gives an empty result, a conversation without turns an empty
audit."""

from __future__ import annotations

import hashlib

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickspark.llm.common import map_rows, table
from clickspark.staging import stage_table

#: Turns solved at a time.
STRETCH = 4096
#: Fixed costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Fixed white space characters.
BLANK = " \t\n\x0b\x0c\r"

#: States of the pattern: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
WHOLE = (START, ASSISTANT)
#: The state that a user or assistant turn leads to from each state.
_NEXT = (USER, USER, ASSISTANT, USER)
#: A turn's code: its initial (0 s, 1 u, 2 a, 3 other) and two flags.
MUST_GO, STOPS_SHORT = 4, 8
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_INF = 1 << 60


def _kept(code: int, state: int) -> int | None:
    """The state after keeping a turn, None where the pattern forbids it."""
    initial = code & 3
    if initial == 0:
        return SYSTEM if state == START else None
    return _NEXT[state] if initial < 3 and _NEXT[state] == initial + 1 else None


def suffix_bounds(codes: bytes, ends) -> list[list[int]]:
    """bounds[i][state]: no edit of turns i.. from ``state`` to one of the
    states ``ends`` costs less."""

    def with_inserts(row: list[int]) -> list[int]:
        for _ in range(2):  # two insertions come back to the same state
            row = [min(c, INSERT + row[_NEXT[s]]) for s, c in enumerate(row)]
        return row

    bounds = [with_inserts([0 if s in ends else _INF for s in range(4)])]
    for code in reversed(codes):
        after, stay, row = bounds[-1], TRUNCATED if code & STOPS_SHORT else 0, []
        for s in range(4):
            best = DELETE + after[s]
            if not code & MUST_GO:
                best = min(best, REROLE + stay + after[_NEXT[s]])
                k = _kept(code, s)
                if k is not None:
                    best = min(best, stay + after[k])
            row.append(best)
        bounds.append(with_inserts(row))
    return bounds[::-1]


# a prefix is (cost, number of edits, last letter, prefix before it)
def _audit(p: tuple) -> str:
    out = []
    while p[3] is not None:
        out.append(p[2])
        p = p[3]
    return "".join(reversed(out))


def _letters_less(a: tuple, b: tuple) -> bool:
    """Is a's audit before b's in ASCII order?"""
    n = a[1] - b[1]
    x, y = a, b
    while x[1] > y[1]:
        x = x[3]
    while y[1] > x[1]:
        y = y[3]
    less = n < 0
    while x is not y and x[3] is not None:
        if x[2] != y[2]:
            less = x[2] < y[2]
        x, y = x[3], y[3]
    return less


def search(codes: bytes, start: int = START, ends=WHOLE) -> tuple[int, str] | None:
    """Least (cost, audit) that edits the turns from state ``start`` to one of
    ``ends``; None where there is none."""
    bounds, n = suffix_bounds(codes, ends), len(codes)
    if bounds[0][start] >= _INF:
        return None
    best: tuple | None = None
    seen: dict[int, tuple] = {}
    stack = [(0, start, (0, 0, "", None))]
    while stack:
        i, state, p = stack.pop()
        full = p[0] + bounds[i][state]
        if best is not None and (full > best[0] or full == best[0] and not _letters_less(p, best)):
            continue
        old = seen.get(4 * i + state)
        if old is not None and (old[0] < p[0] or old[0] == p[0] and not _letters_less(p, old)):
            continue
        seen[4 * i + state] = p
        if i == n and state in ends:
            best = p
            continue
        nexts = [(p[0] + INSERT, "I", i, _NEXT[state])]
        if i < n:
            code = codes[i]
            nexts.append((p[0] + DELETE, "D", i + 1, state))
            if not code & MUST_GO:
                stay = p[0] + (TRUNCATED if code & STOPS_SHORT else 0)
                nexts.append((stay + REROLE, "R", i + 1, _NEXT[state]))
                k = _kept(code, state)
                if k is not None:
                    nexts.append((stay, "K", i + 1, k))
        nexts = [x for x in nexts if bounds[x[2]][x[3]] < _INF]
        nexts.sort(key=lambda x: (x[0] + bounds[x[2]][x[3]], x[1]), reverse=True)
        stack.extend((j, s, (cost, p[1] + 1, letter, p)) for cost, letter, j, s in nexts)
    return best[0], _audit(best)


def chained(stretches) -> tuple[int, str]:
    """Least (cost, audit) over stretches in order, each {(state in, state
    out): (cost, audit)}: prefixes that reach a state are dominated by its
    least one."""
    best = {START: (0, "")}
    for links in stretches:
        now: dict[int, tuple[int, str]] = {}
        for (a, b), (cost, audit) in links.items():
            if a in best:
                new = (best[a][0] + cost, best[a][1] + audit)
                if b not in now or new < now[b]:
                    now[b] = new
        best = now
    return min(best[s] for s in WHOLE if s in best)


def turns_of(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls as one space, and the digest of
    (conversation, role, text)."""
    df = df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                   F.coalesce("text", F.lit(" ")).alias("text"))
    whole = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"),
                     F.length("role").cast("string"), F.lit(":"), "role", "text")
    return df.withColumn("digest", F.unhex(F.substring(F.sha2(whole, 256), 1, 32)))


def faults(turns: DataFrame) -> DataFrame:
    """One row per different (conv_id, turn, role, text): ``copies``, ``code``
    and ``later`` (the same role and text stand at an earlier turn)."""
    end = F.rtrim("text", F.lit(BLANK))
    first = F.substring("role", 1, 1)
    code = (F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
            + F.when(end == "", MUST_GO).when(F.substring(end, -1, 1).isin(".", "!", "?"), 0).otherwise(STOPS_SHORT))
    narrow = turns.select("conv_id", "turn", "role", "digest", code.alias("code")).groupBy(
        "conv_id", "turn", "role", "digest", "code").agg(F.count(F.lit(1)).alias("copies"))
    again = narrow.groupBy("digest").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("at")).where(
        "at > 1").select("digest", "first")
    return narrow.join(again, "digest", "left").select(
        "conv_id", "turn", "role", "digest", "code", "copies",
        (F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))).alias("later"))


_STRETCH_ROW = ("conv_id long, task int, n int, head int, tail int, low long, high long, turns long, blank long, "
                "duplicate long, truncated long, illegal long, whole boolean, starts array<int>, ends array<int>, "
                "costs array<long>, audits array<string>")
_FIELDS = [x.split()[0] for x in _STRETCH_ROW.split(", ")]


class _Stretch:
    """Turns of one conversation, in order, as far as they are solved at once."""

    def __init__(self, conv):
        self.conv, self.codes = conv, bytearray()
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, code, copies, later):
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        blank = bool(code & MUST_GO)
        self.blank += copies if blank else 0
        self.duplicate += 0 if blank else copies - (not later)
        self.truncated += bool(code & STOPS_SHORT) and not later
        if self.codes and (self.codes[-1] & 3, code & 3) not in _LEGAL:
            self.illegal += 1
        self.illegal += copies - 1
        gone = code & 3 | MUST_GO
        self.codes.append(gone if blank or later else code)
        self.codes.extend(bytes([gone]) * (copies - 1))

    def row(self, task, n, whole) -> tuple:
        codes = bytes(self.codes)
        if whole:
            solved = [(START, ASSISTANT, *search(codes))]
        else:
            solved = [(a, b, *x) for a in range(4) for b in range(4) if (x := search(codes, a, (b,))) is not None]
        return (self.conv, task, n, codes[0] & 3, codes[-1] & 3, self.low, self.high, self.turns, self.blank,
                self.duplicate, self.truncated, self.illegal, whole, *map(list, zip(*solved)))


def _columns(names, rows) -> dict:
    return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}


def _flat(batches, *names):
    for b in batches:
        yield from zip(*(b[n] for n in names))


def _batched(names, rows, size=4096):
    out = []
    for r in rows:
        out.append(r)
        if len(out) >= size:
            yield _columns(names, out)
            out = []
    yield _columns(names, out)


def stretches(rows: DataFrame) -> DataFrame:
    """Solved stretches of ``faults`` rows; a conversation that begins and ends
    inside a task and is short enough is solved as a whole."""

    def solve(batches):
        task = TaskContext.get().partitionId()

        def out():
            now, n, first = None, 0, True  # `first`: the conversation may have begun in an earlier task
            for conv, turn, code, copies, later in _flat(batches, "conv_id", "turn", "code", "copies", "later"):
                if now is not None and conv != now.conv:
                    yield now.row(task, n, n == 0 and not first)
                    now, n, first = None, 0, False
                elif now is not None and len(now.codes) >= STRETCH:
                    yield now.row(task, n, False)
                    now, n = None, n + 1
                while copies > STRETCH:  # copies beyond the first stretch are all duplicates, or all blank
                    part = now or _Stretch(conv)
                    part.add(turn, code, STRETCH, later)
                    yield part.row(task, n, False)
                    now, n, copies, later = None, n + 1, copies - STRETCH, True
                now = now or _Stretch(conv)
                now.add(turn, code, copies, later)
            if now is not None:
                yield now.row(task, n, False)

        yield from _batched(_FIELDS, out(), 256)

    keys = ("conv_id", "turn", "role", "digest")
    return map_rows(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                    .select("conv_id", "turn", "code", "copies", "later"), solve, _STRETCH_ROW)


_AUDIT_ROW = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
              "audit string")


def repairs(df: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every
    conversation that has a turn."""
    solved = stage_table(stretches(faults(turns_of(df))))
    gaps = F.when(F.col("turns") > 0, F.col("high") - F.col("low") + 1 - F.col("turns")).otherwise(0)
    short = solved.where("whole").select(
        "conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))

    def chain(batches):
        def joined(group):
            low = high = tail = None
            turns = counts = 0, 0, 0, 0
            turns, illegal = 0, 0
            for r in group:
                if r["low"] is not None:
                    turns += r["turns"] - (r["low"] == high)  # a turn number cut by the border counts once
                    low, high = r["low"] if low is None else low, r["high"]
                if tail is not None and (tail, r["head"]) not in _LEGAL:
                    illegal += 1
                tail = r["tail"]
                counts = tuple(a + r[c] for a, c in zip(counts, ("blank", "duplicate", "truncated", "illegal")))
            cost, audit = chained({(a, b): (c, t) for a, b, c, t in zip(r["starts"], r["ends"], r["costs"], r["audits"])}
                                  for r in group)
            return (group[0]["conv_id"], 0 if high is None else high - low + 1 - turns, *counts[:3], counts[3] + illegal,
                    cost, audit)

        def out():
            group = []
            for r in _flat(batches, *_FIELDS):
                r = dict(zip(_FIELDS, r))
                if group and group[0]["conv_id"] != r["conv_id"]:
                    yield joined(group)
                    group = []
                group.append(r)
            if group:
                yield joined(group)

        yield from _batched([x.split()[0] for x in _AUDIT_ROW.split(", ")], out(), 64)

    parts = solved.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "task", "n")
    return short.union(map_rows(parts, chain, _AUDIT_ROW))


def repaired(df: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, position, role, text of the repaired turns, each conversation's
    in order within one partition."""
    turns = turns_of(df).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text")
    heads = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"),
                          F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"))
    rows = turns.union(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")

    def edit(batches):
        def out():
            conv, audit, at, state, position = None, "", 0, START, 0

            def inserts():
                nonlocal at, state, position
                while at < len(audit) and audit[at] == "I":
                    at, state, position = at + 1, _NEXT[state], position + 1
                    yield conv, position - 1, "user" if state == USER else "assistant", ""

            for c, kind, role, text in _flat(batches, "conv_id", "kind", "role", "text"):
                if kind == 0:
                    yield from inserts()
                    conv, audit, at, state, position = c, text, 0, START, 0
                    continue
                yield from inserts()
                letter, at = audit[at], at + 1
                if letter == "D":
                    continue
                state = SYSTEM if letter == "K" and role[:1] == "s" else _NEXT[state]
                yield c, position, role if letter == "K" else "user" if state == USER else "assistant", text
                position += 1
            yield from inserts()

        yield from _batched(["conv_id", "position", "role", "text"], out(), 1024)

    return map_rows(rows.select("conv_id", "kind", "role", "text"), edit,
                    "conv_id long, position long, role string, text string")


def _digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of ``role:text`` lines per conversation, over the rows of
    ``repaired`` as they come."""

    def digest(batches):
        def out():
            conv, h = None, None
            for c, position, role, text in _flat(batches, "conv_id", "position", "role", "text"):
                if position == 0:
                    if h is not None:
                        yield conv, h.hexdigest()
                    conv, h = c, hashlib.sha256()
                h.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            if h is not None:
                yield conv, h.hexdigest()

        yield from _batched(["conv_id", "repaired_sha256"], out())

    return map_rows(turns, digest, "conv_id long, repaired_sha256 string")


def damaged(df: DataFrame) -> DataFrame:
    """Conversations damaged by crc32(``conv_id:turn``) % 20 (nulls one space):
    0 drops the row, 1 empties its text, 2 removes its ``. ! ?``, 3 repeats it,
    4 makes its role user."""
    name = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c)
                      for c in ("conv_id", ":", "turn")))
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                     F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(name) % 20).alias("hit"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))
    return rows.where("hit <> 0").select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"), F.explode(copies).alias("copy")).drop("copy")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: every conversation, damaged and repaired."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = damaged(given)
    audits = stage_table(repairs(turns))
    found = audits.join(_digests(repaired(turns, audits)).withColumnRenamed("conv_id", "c"),
                        F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c").withColumnRenamed("conv_id", "c")
    ids = given.select("conv_id").distinct()
    empty = hashlib.sha256(b"").hexdigest()
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
