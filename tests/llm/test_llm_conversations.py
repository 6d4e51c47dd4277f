"""Repairs against a plain search over all edit sequences, faults and digests against plain loops."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from driftline.llm import conversations as conv
from driftline.llm.queries import QUERIES

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """(cost, audit, repaired) by uniform-cost search over edits; rows are (role, text, has to go, truncated)."""
    queue = [(0, "", 0, "", ())]
    seen = set()
    while queue:
        cost, audit, k, roles, out = heapq.heappop(queue)
        if k == len(rows) and LEGAL.match(roles):
            return cost, audit, out
        state = (k, bool(roles), roles[-1:])
        if state in seen:
            continue
        seen.add(state)

        def go(more, letter, step, role, text=None):
            initial = role[:1] if role is not None else ""
            now = roles + (initial or "?") if role is not None else roles
            if role is not None and not (LEGAL.match(now) or LEGAL.match(now + "a") or LEGAL.match(now + "ua")):
                return
            heapq.heappush(queue, (cost + more, audit + letter, k + step, now, out + ((role, text),) if role is not None else out))

        for role in ("user", "assistant"):
            go(3, "I", 0, role, "")
        if k < len(rows):
            role, text, gone, cut = rows[k]
            go(4, "D", 1, None)
            if not gone:
                go(3 if cut else 0, "K", 1, role, text)
                for new in ("user", "assistant"):
                    go(6 if cut else 3, "R", 1, new, text)


def plain(rows):
    """What the operator returns for one conversation's rows (turn, role, text), in order."""
    turns = [t for t, _, _ in rows if t is not None]
    counts, marked, seen = dict.fromkeys(("blank", "duplicate", "truncated"), 0), [], set()
    for _, role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = cheapest(marked)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def ordered(rows):
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, signature string, audit int").repartition(5)
    found = conv.repairs(df)
    digests = {r.conv: r.sha256 for r in conv.repaired_digests(df, found).collect()}
    lines = {}
    for r in conv.repaired_rows(df, found).orderBy("conv", "position").collect():
        lines.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    out = {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests[r.conv]) for r in found.collect()}
    assert {c: hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c in out} == digests
    return out


def test_every_short_signature():
    """All signatures of up to four rows, node by node, against the search."""
    texts = {False: "ok.", True: "cut"}
    for n in range(5):
        for letters in itertools.product("suaoSUAOx", repeat=n):
            rows = [({"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}[c.lower()], texts[c.isupper()], c == "x", c.isupper()) for c in letters]
            costs, edits = [conv.END[0]], [conv.END[1]]
            for c in reversed(letters):
                cost, edit = conv.node(c, costs[-1])
                costs.append(cost)
                edits.append(edit)
            assert (costs[-1][0], conv.audit_of("".join(letters), edits)) == cheapest(rows)[:2], letters


def test_random_conversations(spark):
    rng = random.Random(3)
    rows = []
    for c in range(250):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "User"])
            text = rng.choice(["Fine.", "Fine.", "Why?", "cut off", " \t", "", None, "done! \n", "a "]) if rng.random() < 0.7 else f"No {turn}."
            rows.append((c if c else None, rng.choice([turn, turn, turn, turn + 2, None]), role, text))
    rows += rows[40:60]  # repeated rows
    want = {c: plain(ordered([r[1:] for r in rows if r[0] == c])) for c in {r[0] for r in rows}}
    assert got(spark, rows) == want


def test_long_and_common_conversations(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"line {t}." if t % 7 else f"line {t}") for t in range(3000)]
    rows += [(c, t, "user", "the same.") for c in range(10, 500) for t in (0, 1)]
    found = got(spark, rows)
    cuts = sum(t % 7 == 0 for t in range(3000))
    assert found[1][:6] == (0, 0, 0, cuts, 0, 3 * cuts) and found[1][6] == "K" * 3000
    assert {found[c] for c in range(10, 500)} == {plain([(0, "user", "the same."), (1, "user", "the same.")])}


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    found = conv.repairs(none)
    assert found.count() == 0 and conv.repaired_rows(none, found).count() == 0 and conv.repaired_digests(none, found).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in (1, 2, None) for t in [*range(200), None]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, how string")
    want = []
    for c, t, role, text in rows:
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if how:
            row = (c, t, "user" if how == 4 else role, "" if how == 1 else "One Two Three" if how == 2 else text)
            want += [row] * (2 if how == 3 else 1)
    assert sorted(map(tuple, conv.damaged(df).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("table", [[], [(7, None, None, None)]])
def test_query_on_small_tables(spark, tmp_path, table):
    spark.createDataFrame(table, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = QUERIES["op12_conversations"](spark, str(tmp_path)).collect()
    how = zlib.crc32(b"7: ") % 20
    assert how > 0
    assert [tuple(r) for r in out] == [(7, 0, 1, 1 if how == 3 else 0, 0, 1 if how == 3 else 0, 4, "D", hashlib.sha256(b"").hexdigest())][: len(table)]
