"""Conversation structure repair: cheapest edits to a legal order of roles, by a suffix-shared automaton.

A legal conversation is empty or has roles `system? (user assistant)+`, told by their initials. Each row is one letter of its conversation's
signature: what its role is, whether it is truncated, and whether it has to go (blank, or role and text seen earlier). Whatever comes before,
the cheapest way to end a conversation depends on its last rows and the state of the grammar alone, so signatures are shared from the end:
they are sorted by their reversed letters over the whole corpus, and a stack holds the nodes of the current signature's endings. Signatures
that end alike lie side by side and find these nodes on the stack; each node computes, once for each of the four grammar states, the cost to
go and the edit with which its best audit goes on. A hot signature is one path, and its conversations are cut into ranges by their id.

Edits: K keep (0), R rerole to user or assistant (3), D delete (4), I insert an empty user or assistant row (3); a truncated row that stays adds 3.
Ties go to the audit that is least in ASCII. All choices at a node and state start with different letters, so the letter decides.

Rows of a conversation are ordered by turn (nulls first), then role, then the digest of the text, so equal turns have a defined order. Null
ids form one conversation, null roles and texts count as one space. Long conversations stream through sorted partitions: a task holds a
letter per row and the audit of one conversation, not its texts. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.session import settle

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
# States of the grammar: 0 start, 1 after system, 2 after user, 3 after assistant; 0 and 3 may end.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WANTED = (2, 2, 3, 2)  # the state after the user or assistant row that a state waits for
ROLE = ("user", "user", "assistant", "user")
END = ((0, 6, 3, 0), ("", "I", "I", ""))  # cost to go and next edit of each state when no rows are left


def node(letter: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Cost to go and first edit of each state for rows that start with `letter`, from the costs of the rows after it."""
    best = []
    role, extra = letter.lower(), 3 if letter.isupper() else 0
    for q in range(4):
        ways = [(4 + after[q], "D")]
        if letter != "x":
            ways.append((3 + extra + after[WANTED[q]], "R"))
            if role in NEXT[q]:
                ways.append((extra + after[NEXT[q][role]], "K"))
        best.append(min(ways))
    best[2], best[3] = min(best[2], (3 + best[3][0], "I")), min(best[3], (3 + best[2][0], "I"))
    for q in (0, 1):
        best[q] = min(best[q], (3 + best[2][0], "I"))
    return tuple(c for c, _ in best), tuple(e for _, e in best)


def audit_of(signature: str, edits: list[tuple[str, ...]]) -> str:
    """The edits from the start of a signature; `edits[k]` are the first edits of its last k rows."""
    out, left, q = [], len(signature), 0
    while edit := edits[left][q]:
        out.append(edit)
        if edit == "K":
            q = NEXT[q][signature[-left].lower()]
        elif edit != "D":
            q = WANTED[q]
        left -= edit != "I"
    return "".join(out)


def _rows(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, digest): nulls of role and text as one space."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), own(role).alias("role"), own(text).alias("text")).withColumn(
        "digest", F.unhex(F.md5("text")))


def _order(*first: str) -> list[Column]:
    return [*[F.col(c) for c in first], F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def faulty(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, digest, seen, fault): a row per row; how often role and text were seen with it; first fault: blank, duplicate, truncated or null."""
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    rows = _rows(conversations, conv, turn, role, text).withColumn("last", last).drop("text")
    seen = F.row_number().over(Window.partitionBy("conv", "role", "digest").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(F.col("last") == "", "blank").when(F.col("seen") > 1, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    return rows.repartition("conv").withColumn("seen", seen).select("conv", "turn", "role", "digest", "seen", fault.alias("fault"))


def signatures(rows: DataFrame) -> DataFrame:
    """(conv, signature, gaps, blank, duplicate, truncated, illegal) per conversation, from the rows of `faulty`."""
    names = ["signature", "gaps", "blank", "duplicate", "truncated", "illegal"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, kind = None, None, None

        def closed():
            turns, low, high = state["turns"], state["low"], state["high"]
            gaps = high - low + 1 - turns if turns else 0
            return (now[0], state["letters"].decode(), gaps, *[state[f] for f in names[2:]])

        def batch_of(out):
            return pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out], pa.string()), *[pa.array([o[k] for o in out], pa.int64()) for k in range(2, 7)]], ["conv", *names])

        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for conv, turn, role, fault in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if now != (conv,):
                    if now:
                        out.append(closed())
                    now, state = (conv,), {"letters": bytearray(), "turns": 0, "low": turn, "high": None, "initial": None} | dict.fromkeys(names[2:], 0)
                if turn is not None and turn != state["high"]:
                    state["low"] = turn if state["turns"] == 0 else state["low"]
                    state["high"], state["turns"] = turn, state["turns"] + 1
                initial = role[:1]
                if state["initial"] is not None and state["initial"] + initial not in ("su", "ua", "au"):
                    state["illegal"] += 1
                state["initial"] = initial
                if fault:
                    state[fault] += 1
                known = initial if initial and initial in "sua" else "o"
                state["letters"] += ("x" if fault in ("blank", "duplicate") else known.upper() if fault else known).encode()
            if out:
                yield batch_of(out)
        if now:
            yield batch_of([closed()])

    conv_type = rows.schema["conv"].dataType.simpleString()
    ordered = rows.repartition("conv").sortWithinPartitions(*_order("conv"), "seen").select("conv", "turn", "role", "fault")
    return ordered.mapInArrow(fold, f"conv {conv_type}, signature string, gaps long, blank long, duplicate long, truncated long, illegal long")


def solved(signed: DataFrame) -> DataFrame:
    """All columns of `signed` (conv, signature, ...) with cost and audit: one scan of the signatures in the order of their endings."""
    ordered = signed.withColumn("_ending", F.reverse("signature"))
    ordered = ordered.repartitionByRange("_ending", "conv").sortWithinPartitions("_ending", "conv").drop("_ending")
    at = signed.columns.index("signature")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, audit, costs, edits = None, "", [END[0]], [END[1]]  # by number of rows from the end
        for batch in batches:
            found = []
            for signature in batch.column(at).to_pylist():
                if signature != before:
                    ending, old = signature[::-1], (before or "")[::-1]
                    shared = next((k for k, (x, y) in enumerate(zip(ending, old)) if x != y), min(len(ending), len(old)))
                    del costs[shared + 1 :], edits[shared + 1 :]
                    for letter in ending[shared:]:
                        cost, edit = node(letter, costs[-1])
                        costs.append(cost)
                        edits.append(edit)
                    before, audit = signature, audit_of(signature, edits)
                found.append((costs[-1][0], audit))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], [*batch.schema.names, "cost", "audit"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in signed.schema)
    return ordered.mapInArrow(scan, f"{schema}, cost long, audit string")


def repairs(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, signature, gaps, blank, duplicate, truncated, illegal, cost, audit) per conversation."""
    return solved(settle(signatures(faulty(conversations, conv, turn, role, text))))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, edit, turn, role, text) of every edit, and (conv, None, ...) after each conversation; rows come as (conv, audit, turn, role, text)."""
    conv, audit, q, k = None, None, 0, 0

    def inserts():
        nonlocal q, k
        while k < len(audit) and audit[k] == "I":
            yield conv, "I", None, ROLE[q], ""
            q, k = WANTED[q], k + 1

    for batch in batches:
        for c, a, turn, role, text in zip(*[batch.column(n).to_pylist() for n in range(5)]):
            if a is not None:  # sorted before the conversation's rows
                if audit is not None:
                    yield from inserts()
                    yield conv, None, None, None, None
                conv, audit, q, k = c, a, 0, 0
                continue
            yield from inserts()
            edit = audit[k]
            k += 1
            if edit == "R":
                role, q = ROLE[q], WANTED[q]
            elif edit == "K":
                q = NEXT[q][role[0]]
            yield c, edit, turn, role, text
    if audit is not None:
        yield from inserts()
        yield conv, None, None, None, None


def _with_audits(conversations: DataFrame, found: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = _rows(conversations, conv, turn, role, text).withColumn("audit", F.lit(None).cast("string"))
    audits = found.select("conv", "audit", F.lit(None).cast("long").alias("turn"), *[F.lit(None).cast("string").alias(c) for c in ("role", "text")], F.lit(None).cast("binary").alias("digest"))
    both = rows.unionByName(audits).repartition("conv")
    return both.sortWithinPartitions(F.col("conv"), F.col("audit").isNull(), *_order()).select("conv", "audit", "turn", "role", "text")


def repaired_rows(conversations: DataFrame, found: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, position, edit, turn, role, text): the repaired conversations; `found` is the result of `repairs`. Inserted rows have no turn."""
    conv_type = conversations.schema[conv].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, position = [], 0
        schema = None

        def typed(batches):
            nonlocal schema
            for batch in batches:
                schema = pa.schema([batch.schema.field(0), ("position", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
                yield batch

        def made():
            return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*out), schema)], schema=schema)

        for c, edit, *row in _edited(typed(batches)):
            if edit is None:
                position = 0
            elif edit != "D":
                out.append((c, position, edit, *row))
                position += 1
            if len(out) >= 1000:
                yield made()
                out = []
        if out:
            yield made()

    return _with_audits(conversations, found, conv, turn, role, text).mapInArrow(apply, f"conv {conv_type}, position long, edit string, turn long, role string, text string")


def repaired_digests(conversations: DataFrame, found: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, sha256): lower-case hex over the repaired `role:text` lines, for every conversation of `found`."""
    conv_type = conversations.schema[conv].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def typed(batches):
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        out, total, glue = [], hashlib.sha256(), b""
        for c, edit, _, role, text in _edited(typed(batches)):
            if edit is None:
                out.append((c, total.hexdigest()))
                total, glue = hashlib.sha256(), b""
            elif edit != "D":
                total.update(glue + f"{role}:{text}".encode())
                glue = b"\n"
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out])], ["conv", "sha256"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out])], ["conv", "sha256"])

    return _with_audits(conversations, found, conv, turn, role, text).mapInArrow(digest, f"conv {conv_type}, sha256 string")


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) with planted faults, by crc32 of `conv:turn` modulo 20; nulls count as one space in the sum, role and text.

    0 drops the row, 1 empties its text, 2 removes `.`, `!` and `?`, 3 repeats the row, 4 makes it the user's.
    """
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = (F.crc32(F.concat(own(conv), F.lit(":"), own(turn)).cast("binary")) % 20).alias("how")
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), own(role).alias("role"), own(text).alias("text"), how).where("how <> 0")
    rows = rows.withColumns({
        "role": F.when(F.col("how") == 4, "user").otherwise(F.col("role")),
        "text": F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "times": F.when(F.col("how") == 3, 2).otherwise(1)})
    return rows.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times")))).select("conv", "turn", "role", "text")
