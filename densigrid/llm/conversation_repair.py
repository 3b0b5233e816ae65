"""Repair of conversations: the cheapest edits that make the roles of a conversation's turns follow ``(s?(ua)+)?``, by a forward Viterbi pass over four states.

Rows are dealt by ranges of (conversation, turn, role, text), so a conversation may lie on several tasks. Conversations within one task are repaired there. Those at its
ends, the only ones that can go on in another, are repaired in segments: a segment gives the cheapest way from every state to every state, the ways of a conversation's
segments are put together, and each segment is then edited along the way chosen. A task holds the rows of one segment. Where a digest of a whole conversation is asked for,
its repaired text runs through one task, a segment at a time, since such a digest is made in order.

Null roles and texts count as one space; null turns come first, null conversations are one conversation; rows of one turn are taken by role and text. Rows of which
there are copies are kept and count as duplicates. A role that starts with none of s, u, a fits nowhere. Extra columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from densigrid.llm.common import written

SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3  # what edits cost, and what a truncated row that stays adds
NAMES = {"u": "user", "a": "assistant"}  # rows can be given these roles
# States: nothing yet, after a system row, a user's, an assistant's. Where a row of this initial leads; the first and last state may end a conversation.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
Way = tuple[int, int, int]  # cost, rank of the audit without its trailing inserts among those of the layer, trailing inserts
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
COUNTS = "least long, most long, turns long, first_turn long, last_turn long, first_role string, last_role string, blank long, duplicate long, truncated long, illegal long"


def _inserted(ways: list[Way | None]) -> list[Way | None]:
    """The layer closed under insertions. Two are enough: after them every state that insertions can reach has been met."""
    for _ in range(2):
        for (state, initial), to in STEPS.items():
            if initial in NAMES and ways[state]:
                cost, rank, k = ways[state]
                if ways[to] is None or (cost + INSERT, rank, k + 1) < ways[to]:
                    ways[to] = (cost + INSERT, rank, k + 1)
    return ways


def _start(state: int, closed: bool) -> tuple:
    ways: list[Way | None] = [None] * 4
    ways[state] = (0, 0, 0)
    return tuple(_inserted(ways) if closed else ways)


@cache
def _layer(ways: tuple, initial: str, unfit: bool, cut: bool) -> tuple[int, tuple, tuple]:
    """(cost common to all, ways after a row, (rank before, letters added) of each new rank).

    Audits of one layer have as many row letters, so those that differ up to the last of them compare by rank, whatever follows. Costs are kept relative and ways that
    can't win are dropped, so few different layers exist and each is worked out once.
    """
    found: list[list] = [[], [], [], []]
    for state, way in enumerate(ways):
        if way is None:
            continue
        cost, rank, k = way
        found[state].append((cost + DELETE, rank, "I" * k + "D"))
        if not unfit:
            cost += TRUNCATED * cut
            for to_initial in ("s", "u", "a"):
                to = STEPS.get((state, to_initial))
                if to is not None and to_initial == initial:
                    found[to].append((cost, rank, "I" * k + "K"))
                elif to is not None and to_initial in NAMES:
                    found[to].append((cost + REROLE, rank, "I" * k + "R"))
    best = [min(x) if x else None for x in found]
    cores = sorted({b[1:] for b in best if b})
    after = _inserted([b and (b[0], cores.index(b[1:]), 0) for b in best])
    nothing, system, done = after[0], after[1], after[3]
    if done and nothing and nothing[0] > done[0] + DELETE:  # a kept system row can be deleted instead, all else goes on as well from the last state
        after[0] = None
    if done and system and system[0] > done[0]:
        after[1] = None
    used = sorted({w[1] for w in after if w})
    least = min(w[0] for w in after if w)
    return least, tuple(w and (w[0] - least, used.index(w[1]), w[2]) for w in after), tuple(cores[r] for r in used)


def viterbi(rows: list[tuple[str, bool, bool]], state: int = 0, closed: bool = True) -> dict[int, tuple[int, str]]:
    """{end state: (cost, audit)} of the cheapest edits of rows (initial of the role, must go, truncated) from a state, of equally cheap ones the least audit."""
    ways, total, back = _start(state, closed), 0, []
    for row in rows:
        least, ways, cores = _layer(ways, *row)
        total += least
        back.append(cores)
    out = {}
    for end, way in enumerate(ways):
        if way:
            cost, rank, k = way
            letters = ["I" * k]
            for cores in reversed(back):
                rank, added = cores[rank]
                letters.append(added)
            out[end] = (total + cost, "".join(reversed(letters)))
    return out


def edited(rows: list[tuple[str, str]], audit: str, state: int = 0) -> list[tuple[str, str | None, str]]:
    """(edit, role, text) for each letter of the audit; a deleted row's role is null."""
    out, at = [], 0
    for edit in audit:
        if edit == "I":
            role, text = NAMES["a" if state == 2 else "u"], ""
        else:
            role, text = rows[at]
            at += 1
            if edit == "D":
                out.append((edit, None, text))
                continue
            if edit == "R":
                role = NAMES["a" if state == 2 else "u"]
        state = STEPS[state, role[:1]]
        out.append((edit, role, text))
    return out


def as_text(lines: list[tuple[str, str | None, str]]) -> str | None:
    """The repaired turns as role:text, newline-joined; None without any."""
    kept = [f"{role}:{text}" for _, role, text in lines if role is not None]
    return "\n".join(kept) if kept else None


def _counts(rows: list[dict]) -> dict:
    """What a run of rows holds, such that two adjacent runs' counts can be put together."""
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    seen = [r["blank"] for r in rows], [r["again"] and not r["blank"] for r in rows], [r["cut"] and not r["blank"] and not r["again"] for r in rows]
    roles = [r["role"][:1] for r in rows]
    return {
        "least": min(turns, default=None), "most": max(turns, default=None), "turns": len(set(turns)), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
        "first_role": roles[0], "last_role": roles[-1], **{k: sum(v) for k, v in zip(("blank", "duplicate", "truncated"), seen, strict=True)},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False)),
    }


def _together(parts: list[dict]) -> dict:
    """The summary of adjacent runs of one conversation, without cost and audit."""
    held = [p for p in parts if p["turns"]]
    turns = sum(p["turns"] for p in held) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(held, held[1:], strict=False))
    gaps = max(p["most"] for p in held) - min(p["least"] for p in held) + 1 - turns if held else 0
    joints = sum(a["last_role"] + b["first_role"] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:], strict=False))
    return {"gaps": gaps, **{k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated")}, "illegal": sum(p["illegal"] for p in parts) + joints}


def _kinds(rows: list[dict]) -> list[tuple[str, bool, bool]]:
    return [(r["role"][:1] if r["role"][:1] in ("s", "u", "a") else "", bool(r["blank"] or r["again"]), bool(r["cut"])) for r in rows]


def _whole(rows: list[dict], keep_turns: bool) -> dict:
    """A conversation in memory, repaired."""
    seen: set = set()
    for r in rows:
        key = (r["role"], r["text"])
        r["again"] = key in seen
        seen.add(key)
    ends = viterbi(_kinds(rows))
    cost, audit = min(ends[e] for e in FINAL if e in ends)
    lines = edited([(r["role"], r["text"]) for r in rows], audit)
    out = {**_together([_counts(rows)]), "cost": cost, "audit": audit, "sha256": hashlib.sha256((as_text(lines) or "").encode()).hexdigest()}
    return out | ({"lines": [{"edit": e, "role": r, "text": t} for e, r, t in lines]} if keep_turns else {})


def _fields(ddl: str) -> str:
    """The columns of a table as those of a struct."""
    return ", ".join(x.replace(" ", ": ") for x in ddl.split(", "))


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _ordered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, blank, cut, pos): dealt by ranges in order, with each row's place in it."""
    as_read = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(a) for c, a in ((role, "role"), (text, "text"))))
    order = ["conv", "turn", "role", "text"]
    trimmed = F.rtrim("text", F.lit(SPACES))
    dealt = as_read.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.withColumns({"blank": trimmed == "", "cut": ~F.right(trimmed, F.lit(1)).isin(*ENDS) & (trimmed != ""), "pos": F.monotonically_increasing_id()})


def _repaired(rows: DataFrame, conv: str, turn: str, role: str, text: str, keep_turns: bool) -> tuple[DataFrame, DataFrame]:
    """(whole conversations, rows of those that may lie on several tasks). A segment is numbered by its task and whether it is that task's first or last."""
    ordered = _ordered(rows, conv, turn, role, text)
    kind = ordered.schema["conv"].dataType.simpleString()
    lines = ", lines: array<struct<edit: string, role: string, text: string>>" if keep_turns else ""
    ddl = f"conv {kind}, done struct<{_fields(SUMMARY)}, sha256: string{lines}>, row struct<seg: long, pos: long, turn: long, role: string, text: string, blank: boolean, cut: boolean>"
    schema = _arrow(ddl)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        first = True

        def out(made: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(made, schema=schema)

        def opened(group: list[dict], last: bool) -> list[dict]:
            seg = (group[0]["pos"] >> 33) * 2 + last
            return [{"conv": r["conv"], "done": None, "row": {"seg": seg} | {k: r[k] for k in ("pos", "turn", "role", "text", "blank", "cut")}} for r in group]

        for batch in batches:
            made: list[dict] = []
            for r in batch.to_pylist():
                if held and r["conv"] != held[0]["conv"]:
                    made += opened(held, False) if first else [{"conv": held[0]["conv"], "done": _whole(held, keep_turns), "row": None}]
                    held, first = [], False
                held.append(r)
            if made:
                yield out(made)
        if held:
            yield out(opened(held, not first))

    found = written(ordered.mapInArrow(repair, ddl), "conversations")
    return found.where("done IS NOT NULL").select("conv", "done.*"), found.where("row IS NOT NULL").select("conv", "row.*")


def _marked(rows: DataFrame) -> DataFrame:
    """``rows`` with whether their role and text came earlier in the conversation."""
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv").cast("string"), F.lit("")), F.col("conv").isNull().cast("string"), F.length("role").cast("string"), "role", "text"), 256)
    keyed = rows.withColumn("key", key)
    first = keyed.groupBy("key").agg(F.min("pos").alias("at"))
    return keyed.join(first, "key").withColumn("again", F.col("pos") > F.col("at")).drop("key", "at")


def _segments(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row for each segment with the audit that its conversation's cheapest repair has there and the state it starts in, a summary for each conversation)."""
    kind = marked.schema["conv"].dataType.simpleString()
    each_ddl = f"conv {kind}, seg long, {COUNTS}, ways array<struct<start: int, end: int, cost: long, audit: string>>"
    plan_ddl = f"conv {kind}, seg long, start int, edits string, summary struct<{_fields(SUMMARY)}>"
    each_schema, plan_schema = _arrow(each_ddl), _arrow(plan_ddl)

    def ways(table: pa.Table) -> pa.Table:
        rows = table.sort_by("pos").to_pylist()
        kinds = _kinds(rows)
        found = [{"start": s, "end": e, "cost": c, "audit": a} for s in range(4) for e, (c, a) in viterbi(kinds, s, closed=False).items()]
        return pa.Table.from_pylist([{"conv": rows[0]["conv"], "seg": rows[0]["seg"], **_counts(rows), "ways": found}], schema=each_schema)

    def chosen(table: pa.Table) -> pa.Table:
        """The cheapest way through all segments of a conversation."""
        parts = table.sort_by("seg").to_pylist()
        at: dict = {0: (0, "", None), 2: (INSERT, "I", None), 3: (2 * INSERT, "II", None)}
        for p in parts:
            to: dict = {}
            for w in p["ways"]:
                if w["start"] in at:
                    cost, audit, _ = at[w["start"]]
                    way = (cost + w["cost"], audit + w["audit"], (at[w["start"]][2], w["start"], w["audit"]))
                    if w["end"] not in to or way[:2] < to[w["end"]][:2]:
                        to[w["end"]] = way
            at = to
        cost, audit, path = min((at[e] for e in FINAL if e in at), key=lambda w: w[:2])
        taken = []
        while path:
            path, start, piece = path
            taken.append((start, piece))
        taken.reverse()
        before = audit[: len(audit) - sum(len(a) for _, a in taken)]  # inserted before the first row
        taken[0] = (0, before + taken[0][1])
        sums = _together(parts) | {"cost": cost, "audit": audit}
        return pa.Table.from_pylist([{"conv": p["conv"], "seg": p["seg"], "start": s, "edits": a, "summary": None if k else sums} for k, (p, (s, a)) in enumerate(zip(parts, taken, strict=True))], schema=plan_schema)

    each = marked.groupBy("seg").applyInArrow(ways, each_ddl)
    plan = written(each.groupBy("conv").applyInArrow(chosen, plan_ddl), "conversation-segments")
    return plan.select("seg", "start", "edits"), plan.where("summary IS NOT NULL").select("conv", "summary.*")


def _edits(marked: DataFrame, plan: DataFrame, result: str, of: Callable) -> DataFrame:
    """The segments edited as planned; ``of`` makes the result's rows of (conversation, segment, lines)."""
    schema = _arrow(result)

    def edit(rows: pa.Table, planned: pa.Table) -> pa.Table:
        held, p = rows.sort_by("pos").to_pylist(), planned.to_pylist()[0]
        lines = edited([(r["role"], r["text"]) for r in held], p["edits"], p["start"])
        return pa.Table.from_pylist(of(held[0]["conv"], p["seg"], lines), schema=schema)

    return marked.groupBy("seg").cogroup(plan.groupBy("seg")).applyInArrow(edit, result)


def _digested(texts: DataFrame) -> DataFrame:
    """(conv, sha256) of (conv, seg, text): a conversation's segments in order, newline-joined; those without a text are left out."""
    ddl = f"conv {texts.schema['conv'].dataType.simpleString()}, sha256 string"
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, conv, begun, met = hashlib.sha256(), None, False, False
        for batch in batches:
            out = []
            for c, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if met and c != conv:
                    out.append({"conv": conv, "sha256": held.hexdigest()})
                    held, begun = hashlib.sha256(), False
                conv, met = c, True
                if t is not None:
                    held.update((("\n" if begun else "") + t).encode())
                    begun = True
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if met:
            yield pa.RecordBatch.from_pylist([{"conv": conv, "sha256": held.hexdigest()}], schema=schema)

    return texts.repartition("conv").sortWithinPartitions("conv", "seg").select("conv", "seg", "text").mapInArrow(run, ddl)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation that has rows."""
    whole, rest = _repaired(rows, conv, turn, role, text, keep_turns=False)
    marked = written(_marked(rest), "conversation-rows")
    plan, sums = _segments(marked)
    texts = _edits(marked, plan, f"conv {rest.schema['conv'].dataType.simpleString()}, seg long, text string", lambda c, seg, lines: [{"conv": c, "seg": seg, "text": as_text(lines)}])
    found = sums.withColumnRenamed("conv", "c").join(_digested(texts), F.col("c").eqNullSafe(F.col("conv")))
    columns = [F.col("conv").alias(conv), *(x.split()[0] for x in SUMMARY.split(", ")), F.col("sha256").alias("repaired_sha256")]
    return whole.select(*columns).unionByName(found.select(*columns))


def repaired_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, seg, n, edit, role, text): each edit of a conversation in the order of (seg, n); deleted rows have no role."""
    whole, rest = _repaired(rows, conv, turn, role, text, keep_turns=True)
    marked = written(_marked(rest), "conversation-rows")
    plan, _ = _segments(marked)
    ddl = f"conv {rest.schema['conv'].dataType.simpleString()}, seg long, n int, edit string, role string, text string"
    parts = _edits(marked, plan, ddl, lambda c, seg, lines: [{"conv": c, "seg": seg, "n": n, "edit": e, "role": r, "text": t} for n, (e, r, t) in enumerate(lines)])
    exploded = whole.select("conv", F.lit(0).cast("long").alias("seg"), F.posexplode("lines").alias("n", "x")).select("conv", "seg", "n", "x.*")
    return exploded.unionByName(parts).withColumnRenamed("conv", conv)
