"""Conversation repair against a search over all edit sequences."""

import hashlib
import heapq
import random
import re
import zlib

from pyspark.sql import functions as F

from drift_atlas.llm import conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    out = []
    for k, (_, role, text) in enumerate(rows):
        body = text.strip(SPACE)
        if not body:
            out.append("blank")
        elif any((role, text) == (r, t) for _, r, t in rows[:k]):
            out.append("duplicate")
        else:
            out.append("" if body[-1] in ".!?" else "truncated")
    return out


def search(rows, kinds):
    """Least (cost, audit) and what it writes, by uniform-cost search over (turns used, text of initials written so far)."""
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, k, out = heapq.heappop(heap)
        word = "".join(o[0][0] for o in out)
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", word):
            return cost, audit, out
        state = (k, len(word) and (word[-1]))
        if state in done:
            continue
        done.add(state)

        def step(extra, letter, used, more=(), cost=cost, audit=audit, out=out):
            made = out + more
            if re.fullmatch("(s?(ua)*u?)?", "".join((o[0] or "?")[0] for o in made)):
                heapq.heappush(heap, (cost + extra, audit + letter, used, made))

        for role in ("user", "assistant"):
            step(2, "I", k, ((role, ""),))
        if k < len(rows):
            _, role, text = rows[k]
            step(3, "D", k + 1)
            if kinds[k] in ("", "truncated"):
                cut = int(kinds[k] == "truncated")
                step(cut, "K", k + 1, ((role, text),))
                for other in ("user", "assistant"):
                    step(2 + cut, "R", k + 1, ((other, text),))
    raise AssertionError("no way")


def brute(rows):
    """The whole answer for one conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    kinds = faults(rows)
    numbers = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = search(rows, kinds)
    return gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, [tuple(o) for o in out]


def random_rows(seed, conversations):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", "Yes.", "Ends. \n", "é。", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(1, 9)):
            turn = rng.choice([t, t, t, t + 1, None])
            rows.append((c if c else None, turn, rng.choice(roles), rng.choice(texts)))
    return rows


def test_repair_against_search(spark):
    rows = random_rows(3, 80)
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("place", "initial", "fault", "turns", "best", "audit", "cost", "pair")})
    got = {r.conv_id: r for r in conversation_repair.repair_conversations(frame).collect()}
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn, role or "", text or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        g = got[c]
        assert (g.gaps, g.blank, g.duplicate, g.truncated, g.illegal, g.cost, g.audit, [tuple(t) for t in g.repaired]) == brute(own), c


def test_damage_then_repair(spark):
    """The damage's rules, conversations that lose every row, and null keys."""
    rows = random_rows(8, 60) + [(700 + 3 * k, 1, "user", "Hello there.") for k in range(120)]
    got = {r.conv_id: r for r in conversation_repair.repair_conversations(conversation_repair.damage(spark.createDataFrame(rows, SCHEMA))).collect()}
    by = {}
    for c, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text, own = " " if role is None else role, " " if text is None else text, by.setdefault(c, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    assert set(got) == set(by) and any(not own for own in by.values())
    for c, own in by.items():
        g = got[c]
        assert (g.gaps, g.blank, g.duplicate, g.truncated, g.illegal, g.cost, g.audit, [tuple(t) for t in g.repaired]) == brute(own), c


def test_repair_of_nothing_and_of_a_long_conversation(spark):
    assert conversation_repair.repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(1200)]
    del rows[601]
    out = conversation_repair.repair_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (out[0].gaps, out[0].cost, len(out[0].repaired)) == (1, 2, 1200)
    assert out[0].audit.count("K") == 1199 and out[0].audit.count("I") == 1


def test_query_text_digest(spark, tmp_path):
    from drift_atlas.llm import registry

    rows = [(5, 0, "user", "Hi."), (5, 1, "assistant", "Hello."), (6, 0, "user", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in registry.op11_conversation_repair(spark, str(tmp_path)).collect()}
    damaged = [r for r in rows if r[0] == 5 and zlib.crc32(f"5:{r[1]}".encode()) % 20 > 4]
    if len(damaged) == 2:
        assert got[5].repaired_sha256 == hashlib.sha256(b"user:Hi.\nassistant:Hello.").hexdigest()
    assert got[6].repaired_sha256 == hashlib.sha256(b"").hexdigest() and got[6].blank <= 1
