"""Linked calls: depth, circles, order over turns and answers, against a plain walk over each conversation."""

import collections
import json
import random

from seqlake.llm import chat_format as c

SCHEMA = "conv_id long, turn long, role string, text string"
ORDER = ("order_turn", "order_level", "order_call", "order_part", "turn")


def call(id_, *after, name="f", **arguments):
    return {"id": id_, "name": name, "arguments": arguments, "after": list(after)}


def turn(conv, at, *calls):
    return (conv, at, "assistant", json.dumps({"tool_calls": list(calls)}))


def answer(conv, at, id_):
    return (conv, at, "tool", json.dumps({"tool_call_id": id_, "content": id_}))


def formatted(spark, rows):
    return sorted(c.format_chats(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: (r["conv_id"], *((r[o] is not None, r[o]) for o in ORDER)))


def test_long_chains_settle_in_few_rounds(spark, monkeypatch):
    n, jobs = 1000, []
    real = c.shortened
    monkeypatch.setattr(c, "shortened", lambda e: jobs.append(1) or real(e))
    rows = [turn(1, k, call(f"c{k}", *([f"c{k + 1}"] if k < n - 1 else []))) for k in range(n)] + [answer(1, n, f"c{k}") for k in range(n)]
    rows += [turn(2, 0, call("a", "b"), call("b", "d"), call("d", "b"), call("e"), call("g", "g"))]
    out = formatted(spark, rows)
    calls = [json.loads(r["json"])["id"] for r in out if r["conv_id"] == 1 and r["kind"] == "call"]
    assert calls == [f"c{k}" for k in reversed(range(n))] and {r["status"] for r in out if r["conv_id"] == 1} == {"ok"}
    assert {json.loads(r["json"])["id"]: r["status"] for r in out if r["conv_id"] == 2} == {"a": "circular", "b": "circular", "d": "circular", "g": "circular", "e": "unanswered"}
    assert len(jobs) / 2 < 10


def test_answers_before_their_call(spark):
    out = formatted(spark, [answer(1, 0, "c"), turn(1, 1, call("c")), turn(2, 0, call("c")), answer(2, 1, "c"), answer(2, 2, "c"), answer(3, 0, "x")])
    assert [(r["conv_id"], r["kind"], r["status"]) for r in out] == [(1, "result", "early"), (1, "call", "unanswered"), (2, "call", "ok"), (2, "result", "ok"), (2, "result", "duplicate_result"), (3, "result", "no_call")]


def test_random_conversations(spark):
    r, rows, want = random.Random(5), [], {}
    for conv in range(60):
        ids = [f"c{k}" for k in range(r.randint(1, 12))]
        needs = {i: r.sample([*ids, "nobody"], min(len(ids), r.choice([0, 0, 1, 1, 2, 3]))) for i in ids}
        if conv % 2:  # half without circles
            rank = {i: r.random() for i in ids}
            needs = {i: [j for j in needs[i] if j in rank and rank[j] < rank[i]] for i in ids}
        at = {i: r.randint(0, 4) for i in ids}
        by = collections.defaultdict(list)
        for i in ids:
            by[at[i]].append(i)
        rows += [turn(conv, t, *(call(i, *needs[i]) for i in own)) for t, own in by.items()]
        rows += [answer(conv, 9, i) for i in ids]
        level, ready = {}, {}

        def walk(i, path=(), level=level, ready=ready, needs=needs, at=at):
            if i in path:
                return None
            if i not in level:
                found = [walk(j, (*path, i)) for j in needs[i] if j in at]
                bad = any(x is None for x in found)
                if bad:
                    return None
                level[i] = max((x + 1 for x in found), default=0)
                ready[i] = max([at[i], *(ready[j] for j in needs[i] if j in at)])
            return level[i]

        for i in ids:
            want[conv, i] = (walk(i), ready.get(i, at[i]), needs[i])
    out = formatted(spark, rows)
    place = {(x["conv_id"], json.loads(x["json"])["id"], x["kind"]): k for k, x in enumerate(out)}
    for x in out:
        i = json.loads(x["json"])["id"]
        level, ready, needs = want[x["conv_id"], i]
        if x["kind"] == "call":
            assert (x["status"], x["order_turn"], x["order_level"]) == (("circular", ready, c.LAST) if level is None else ("ok", ready, level))
            if level is not None:
                assert all(place[x["conv_id"], j, "call"] < place[x["conv_id"], i, "call"] for j in needs if (x["conv_id"], j) in want)
        assert place[x["conv_id"], i, "call"] < place[x["conv_id"], i, "result"]


def test_one_conversation_with_all_rows(spark):
    rows = [turn(1, k, call("same", x=k), call(f"c{k}", "same")) for k in range(3000)] + [answer(1, 4000, "same")] * 500
    out = c.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(8)).groupBy("kind", "status").count().collect()
    assert {(r["kind"], r["status"]): r["count"] for r in out} == {("call", "ok"): 1, ("call", "duplicate_id"): 2999, ("call", "unanswered"): 3000, ("result", "ok"): 500}
