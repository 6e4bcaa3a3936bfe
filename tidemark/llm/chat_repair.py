"""Structure repair of conversations: turns aligned with the alternating grammar ``(s?(ua)+)?``.

The targets are the strings of the grammar, one for each feasible length: even lengths are ``uaua..``, odd ones
``s`` before them. Wagner and Fischer's table gives the cheapest edits: Keep (0, the role's initial is the target's),
Rerole to user or assistant (3), Delete (4, a must for blank and repeated turns) and Insert of an empty turn (3); a
turn that breaks off and is not deleted adds 3. All targets end alike, so one table over what is left of turns and
target serves every length. It is kept inside Ukkonen's band: a cell so far off the diagonal that its deletions or
insertions alone cost more than the incumbent, a plain left-to-right repair, is never computed. The lengths of least
cost are traced back together, letter by letter, and the ASCII-least audit wins.

Spark groups and sorts; a task holds one conversation at a time. Work and memory grow with turns times cost.

Defined results: null conversation, turn, role and text count as one space in the fault's key and as role and text
(a null conversation stays null in the result); turns are taken by number, nulls first, then role, then text, so
rows that repeat are duplicates; a conversation without rows after damage has zeros and an empty audit; an empty
table gives no rows. Other columns are ignored. Other damage can be repaired by giving ``repair`` the rows as they are.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import runs

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
FOLLOWS = {"su", "ua", "au"}
_LAST = re.compile(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies (0: dropped): the faults that crc32 of ``conv_id:turn`` deals out."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(h == 4, "user").otherwise(space("role")).alias("role"),
        text.alias("text"),
        F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("copies"),
    )


def target(length: int) -> str:
    return "s" * (length % 2) + "ua" * (length // 2)


def _plain_cost(turns: list[tuple[str, bool, bool]]) -> int:
    """Cost of a left-to-right repair: what must go goes, a turn out of place gets a turn before it or a new role."""
    cost, expected, any_kept = 0, "u", False
    for initial, late, must_go in turns:
        if must_go:
            cost += DELETE
            continue
        cost += TRUNCATED * late
        if initial == "s" and not any_kept:
            any_kept = True
            continue
        any_kept = True
        if initial == expected or initial not in ROLES:
            cost += KEEP if initial == expected else REROLE
            expected = "a" if expected == "u" else "u"
        else:  # the missing turn is put in, this one fits after it
            cost += INSERT
    if expected == "a":
        cost += INSERT
    elif turns and sum(not t[2] for t in turns) == 1 and any_kept and next(t for t in turns if not t[2])[0] == "s":
        cost += 2 * INSERT
    return cost


@lru_cache(maxsize=4096)
def align(turns: tuple[tuple[str, bool, bool], ...]) -> tuple[int, str]:
    """(cost, audit) of turns given as (initial, breaks off, must be deleted)."""
    n = len(turns)
    left = np.zeros(n + 1, np.int64)  # turns from here on that may stay
    for i in range(n - 1, -1, -1):
        left[i] = left[i + 1] + (not turns[i][2])
    spare = _plain_cost(turns) - DELETE * (n - int(left[0]))
    low, high = spare // DELETE, spare // INSERT  # band: left[i] - low <= remaining target <= left[i] + high
    size = low + high + 1
    far = np.int64(1) << 40
    # table[i][k]: least cost of turns i.. against the last left[i] - low + k characters of the target.
    table = np.full((n + 1, size), far, np.int64)
    steps = INSERT * np.arange(size, dtype=np.int64)
    for i in range(n, -1, -1):
        r = left[i] - low + np.arange(size)
        row = table[i]
        if i == n:
            row[r == 0] = 0
        else:
            initial, late, must_go = turns[i]
            shift = int(left[i] - left[i + 1])  # 0 when the turn must go
            below = table[i + 1]
            # Deleted: the same remaining target, seen from the next row.
            row[: size - shift] = below[shift:] + DELETE
            if not must_go:
                fits = np.where(r % 2 == 1, initial == "a", initial == "u")
                used = below + np.where(fits, KEEP, REROLE) + TRUNCATED * late  # one character less: the same place in the next row
                np.minimum(row, np.where(r >= 1, used, far), out=row)
        row[r < 0] = far
        np.minimum(row, np.minimum.accumulate(row - steps) + steps, out=row)
        row[r < 0] = far

    def cost(i: int, r: int) -> int:
        k = r - int(left[i]) + low
        return int(table[i, k]) if 0 <= k < size and r >= 0 else int(far)

    def after_system(p: int, r: int) -> int:
        initial, late, must_go = turns[p]
        return DELETE * p + TRUNCATED * late + cost(p + 1, r) if initial == "s" and not must_go else int(far)

    plain = [(cost(0, r), r) for r in range(0, n + high + 3, 2)]
    opened = [(after_system(p, r), p, r) for p in range(n) if turns[p][0] == "s" and DELETE * p <= spare + DELETE * n for r in range(2, n + high + 3, 2)]
    best = min(c for c, *_ in plain + opened)
    # What can still become the least audit: (turn, remaining target, turn that is kept as the system's or None).
    alive = {(0, r, None) for c, r in plain if c == best} | {(0, r, p) for c, p, r in opened if c == best}
    audit = []
    while not any(i == n and r == 0 for i, r, _ in alive):
        choices: dict[str, set] = {}
        for i, r, p in alive:
            if p is not None:
                choices.setdefault("D" if i < p else "K", set()).add((i + 1, r, p if i < p else None))
                continue
            here = cost(i, r)
            if i < n:
                initial, late, must_go = turns[i]
                if here == DELETE + cost(i + 1, r):
                    choices.setdefault("D", set()).add((i + 1, r, None))
                if not must_go and r:
                    fits = initial == ("a" if r % 2 else "u")
                    if here == (KEEP if fits else REROLE) + TRUNCATED * late + cost(i + 1, r - 1):
                        choices.setdefault("K" if fits else "R", set()).add((i + 1, r - 1, None))
            if r and here == INSERT + cost(i, r - 1):
                choices.setdefault("I", set()).add((i, r - 1, None))
        letter = min(choices)
        audit.append(letter)
        alive = choices[letter]
    return best, "".join(audit)


def faults(rows: list[tuple[str, str]]) -> list[str]:
    """Of each (role, text) its first fault: blank, duplicate, truncated or an empty string."""
    seen, out = set(), []
    for role, text in rows:
        last = _LAST.search(text) if text else None
        k = (role, text)
        out.append("blank" if last is None else "duplicate" if k in seen else "truncated" if last.group() not in ".!?" else "")
        seen.add(k)
    return out


def repaired(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The turns that the audit leaves and makes."""
    goal, out, i = target(sum(a != "D" for a in audit)), [], 0
    for a in audit:
        if a == "I":
            out.append((ROLES[goal[len(out)]], ""))
            continue
        role, text = rows[i]
        i += 1
        if a != "D":
            out.append((ROLES[goal[len(out)]] if a == "R" else role, text))
    return out


def _one(turn: list, rows: list[tuple[str, str]]) -> dict:
    known = {t for t in turn if t is not None}
    f = faults(rows)
    initials = [r[:1] for r, _ in rows]
    cost, audit = align(tuple((c, x == "truncated", x in ("blank", "duplicate")) for c, x in zip(initials, f)))
    text = "\n".join(f"{r}:{t}" for r, t in repaired(rows, audit))
    return {
        "gaps": max(known) - min(known) + 1 - len(known) if known else 0,
        **{k: f.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in FOLLOWS for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "repaired": text,
    }


def repair(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired (``role:text`` by line) of each
    conversation of (conv_id, turn, role, text); the column ``copies`` says how often a row stands there, 0 for not at all."""
    ship(rows.sparkSession)
    kind = dict(rows.dtypes)["conv_id"]
    group = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    text = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    told = rows.select(group.alias("__g"), "conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"), (F.col(copies) if copies else F.lit(1)).alias("copies"))
    told = told.repartition("__g").sortWithinPartitions("__g", F.col("turn").asc_nulls_first(), "role", "text")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def each(batches):
        for t, starts, ends in runs(batches, ["__g"]):
            turn, role, body, many = (t.column(c).to_pylist() for c in ("turn", "role", "text", "copies"))
            found = []
            for s, e in zip(starts, ends):
                at = [i for i in range(s, e) for _ in range(many[i])]
                found.append(_one([turn[i] for i in at], [(role[i], body[i]) for i in at]))
            cols = {c: pa.array([f[c] for f in found], pa.int64()) for c in counts} | {c: pa.array([f[c] for f in found], pa.string()) for c in ("audit", "repaired")}
            ids = t.column("conv_id").take(pa.array(starts)).combine_chunks()
            yield from pa.table({"conv_id": ids} | cols).to_batches()

    return told.mapInArrow(each, f"conv_id {kind}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired string")


def digest(repaired_rows: DataFrame) -> DataFrame:
    return repaired_rows.withColumn("repaired_sha256", F.sha2(F.encode("repaired", "UTF-8"), 256)).drop("repaired")

