import hashlib
import heapq

import numpy as np
import pytest

from callweave.llm import repair

U = repair.Speakers("user", "assistant", "system")
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def brute(turns):
    """Cheapest first search over all edits; equal costs in the order of the audit."""
    seen, rows = set(), []
    for _, speaker, text in turns:
        if not text.strip(" \t\n\v\f\r"):
            fault = "blank"
        elif (speaker, text) in seen:
            fault = "duplicate"
        else:
            fault = "" if text.rstrip(" \t\n\v\f\r")[-1] in ".!?" else "truncated"
        seen.add((speaker, text))
        rows.append((speaker, text, fault))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return rows, cost, audit, out
        step = NEXT[state]
        heapq.heappush(heap, (cost + 3, audit + "I", i, step, (*out, (NAMES[step], ""))))
        if i < len(rows):
            speaker, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if fault in ("", "truncated"):
                late = 3 if fault else 0
                heapq.heappush(heap, (cost + 3 + late, audit + "R", i + 1, step, (*out, (NAMES[step], text))))
                letter = speaker[:1]
                if letter == step or (letter == "s" and state == ""):
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, letter, (*out, (speaker, text))))


def damaged_calls(n, seed=0, longest=9):
    draw = np.random.default_rng(seed)
    speakers, texts = ["user", "assistant", "system", "tool", "user", "assistant"], ["Hi.", "Well", "Yes!", " \n", "", "What?  ", "a b.", "No", "Sure?"]
    calls = {}
    for c in range(n):
        rows = [(t, str(draw.choice(speakers)), str(draw.choice(texts)) + (str(t) + "." if draw.random() < 0.5 else "")) for t in range(draw.integers(1, longest))]
        calls[c] = rows
    return calls


def frame(spark, calls):
    rows = [(c, t, s, x) for c, turns in calls.items() for t, s, x in turns]
    return spark.createDataFrame(rows, "call_id bigint, turn_idx bigint, speaker string, text string")


@pytest.mark.parametrize("block_turns", [1, 3, 4096])
def test_equals_brute_force_for_any_block(spark, block_turns):
    calls = damaged_calls(60, seed=block_turns)
    calls[60] = [(t, ["user", "assistant"][t % 3 % 2], f"line {t}{'.' if t % 4 else ''}") for t in range(40)]
    done = repair.repair_calls(frame(spark, calls), U, block_turns)
    found = {r["call_id"]: r for r in done.calls.collect()}
    digests = {r["call_id"]: r["sha256"] for r in repair.digest_calls(done.turns).collect()}
    assert set(found) == set(calls)
    for c, turns in calls.items():
        rows, cost, audit, out = brute(turns)
        r = found[c]
        assert (r["cost"], r["audit"]) == (cost, audit), turns
        faults = [f for _, _, f in rows]
        assert [r["blank"], r["duplicate"], r["truncated"]] == [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        letters = [s[:1] for s, _, _ in rows]
        assert r["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        assert r["gaps"] == 0
        lines = "\n".join(f"{s}:{x}" for s, x in out)
        assert digests.get(c, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(lines.encode()).hexdigest()


def test_ties_nulls_gaps_and_copies(spark):
    rows = [
        ("x", None, "CUSTOMER", "Hello."), ("x", 5, "AGENT", "Hi."), ("x", 9, "CUSTOMER", "Bye."), ("x", 9, "CUSTOMER", "Bye."),
        (None, 1, None, None), ("y", None, "AGENT", "So."),
    ]
    turns = spark.createDataFrame(rows, "call_id string, turn_idx int, speaker string, text string").selectExpr("*", "1 AS part", "2 AS seq", "3 AS n")
    done = repair.repair_calls(turns)
    found = {r["call_id"]: (r["gaps"], r["blank"], r["duplicate"], r["illegal"], r["cost"], r["audit"]) for r in done.calls.collect()}
    assert found == {"x": (3, 0, 1, 1, 7, "KKKDI"), None: (0, 1, 0, 0, 4, "D"), "y": (0, 0, 0, 0, 3, "IK")}
    left = [(r["call_id"], r["speaker"], r["text"]) for r in done.turns.orderBy("call_id", "place").collect()]
    assert left == [
        ("x", "CUSTOMER", "Hello."), ("x", "AGENT", "Hi."), ("x", "CUSTOMER", "Bye."), ("x", "AGENT", ""), ("y", "CUSTOMER", ""), ("y", "AGENT", "So."),
    ]


def test_many_copies_of_one_turn(spark):
    copies = [(1, 1, "CUSTOMER", "Again.")] * 50
    turns = spark.createDataFrame(copies, "call_id bigint, turn_idx bigint, speaker string, text string")
    row = repair.repair_calls(turns, block_turns=8).calls.first()
    assert (row["audit"], row["cost"], row["duplicate"], row["illegal"]) == ("K" + "D" * 49 + "I", 199, 49, 49)


def test_empty_table(spark):
    turns = spark.createDataFrame([], "call_id bigint, turn_idx bigint, speaker string, text string")
    done = repair.repair_calls(turns)
    assert done.calls.count() == 0 and repair.digest_calls(done.turns).count() == 0


def test_ranks_choose_between_equal_initials():
    """Two edits with the same initial: the one whose target has the lesser audit is taken."""
    arcs, target = np.zeros((6, 5), bool), np.full((6, 5), -1)
    for node, edit, to in [(0, 1, 1), (1, 3, 5), (2, 1, 3), (3, 2, 5)]:
        arcs[node, edit], target[node, edit] = True, to
    letter, pointer, levels = repair._rank(arcs, target)
    assert letter.tolist() == [1, 3, 1, 2, 0, 0] and pointer[[0, 2]].tolist() == [1, 3] and levels[-1][0] == 5
