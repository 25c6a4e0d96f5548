import hashlib
import random
import re
import zlib

import pytest

from clauseloom.llm import repair
from clauseloom.llm.common import read

SHAPE = re.compile("(s?(ua)+)?")


def plain_best(rows):
    """``rows`` of (initial, fault): least cost and least edits, over all edit sequences up to that cost (a search by cost)."""
    import heapq

    heap, done = [(0, "", 0, "")], set()
    best = None
    while heap:
        cost, edits, i, made = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        # What was made matters by its length class and last initial only; of equal cost, the least edits come first.
        last = (made == "s", made[-1:] or "-")
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and SHAPE.fullmatch(made):
            best = min(best, (cost, edits)) if best else (cost, edits)
            continue
        for role in "ua":
            if allowed(made + role):
                heapq.heappush(heap, (cost + 3, edits + "I", i, made + role))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, made))
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                if allowed(made + initial) and initial:
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, made + initial))
                for role in "ua":
                    if allowed(made + role):
                        heapq.heappush(heap, (cost + 3 + more, edits + "R", i + 1, made + role))
    return best


def allowed(made):
    return re.fullmatch("s?(ua)*u?", made) is not None


def letter_of(initial, fault):
    if fault in ("blank", "duplicate"):
        return "x"
    return (initial if initial in "sua" and initial else "o")[0].upper() if fault else (initial if initial and initial in "sua" else "o")


def test_cheapest_edits_against_a_search():
    rng = random.Random(3)
    cases = [[(rng.choice(["s", "u", "a", "t", ""]), rng.choice(["", "", "", "truncated", "blank"])) for _ in range(rng.randrange(9))] for _ in range(1500)]
    signed = sorted(("".join(letter_of(*r) for r in rows)[::-1], rows) for rows in cases)
    path = repair.Path()
    for letters, rows in signed:
        assert path.read(letters) == plain_best(rows), (letters, rows)
    assert len(path.automaton.costs) < 60
    shuffled = list(signed)
    rng.shuffle(shuffled)
    other = repair.Path()
    assert all(other.read(letters) == path.read(letters) for letters, _ in shuffled)


def test_long_conversations():
    letters = "".join(random.Random(4).choice("suaoSUAOx") for _ in range(50_000))
    path = repair.Path()
    cost, audit = path.read(letters)
    assert sum(c != "I" for c in audit) == len(letters) and cost > 0
    assert path.read(letters + "u")[1] and path.read(letters) == (cost, audit)


def plain_rows(rows):
    """Damage, counts and repair of one conversation's (conv_id, turn, role, text) rows."""
    made = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        made += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    made.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, faults = set(), []
    for _, role, text in made:
        solid = re.sub("[\x20\x09-\x0d]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in made if t is not None]
    initials = [r[:1] for _, r, _ in made]
    cost, audit = plain_best(list(zip(initials, faults, strict=True)))
    out, i = [], 0
    for edit in audit:
        if edit != "D":
            kept = edit == "K"
            state = out[-1][0][:1] if out else ""
            role = made[i][1] if kept else "assistant" if state == "u" else "user"
            out.append((role, "" if edit == "I" else made[i][2], edit))
        i += edit != "I"
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count("blank"), "duplicate": faults.count("duplicate"),
        "truncated": faults.count("truncated"), "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t, _ in out).encode()).hexdigest(),
    }, out


def conversations_of(rows):
    grouped = {}
    for row in rows:
        grouped.setdefault(row[0], []).append(row)
    return grouped


def check(table, rows):
    audited, edited = repair.repair(table)
    expected = {conv: plain_rows(own) for conv, own in conversations_of(rows).items()}
    found = {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in repair.repaired_digests(audited, edited).collect()}
    assert found == {conv: facts for conv, (facts, _) in expected.items()}
    texts = {}
    for r in sorted((r for r in edited.collect() if r.place), key=lambda r: r.place):
        texts.setdefault(r.conv_id, []).append((r.role, r.text, r.edit))
    assert texts == {conv: made for conv, (_, made) in expected.items() if made}


def test_against_plain_repair(spark):
    rng = random.Random(5)
    rows = some_rows(rng, 150, 14)
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6), rows)


def some_rows(rng, conversations, most):
    roles, texts = ["user", "assistant", "system", "tool", "", "s", "Up", None], ["Yes.", "No!", "no end", "", " \t", None, "dots . . ", "a?", "long " * 20, "more. ", "thing", "x.y"]
    out = []
    for conv in range(conversations):
        turns = sorted({rng.randrange(most) for _ in range(rng.randrange(1, most))})
        out += [(conv, turn, rng.choice(roles if rng.random() < 0.3 else roles[:2]), rng.choice(texts)) for turn in turns]
        if rng.random() < 0.2:
            out.append((conv, None, "user", "no turn."))
    return out


def test_on_the_table(spark, sf_dir):
    table = read(spark, sf_dir, "conversations")
    check(table, [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, head boolean, h1 long, copies string, place int, audit string"
    rows = [
        (None, None, None, None), (None, 1, "user", "Question?"), (1, None, "user", "q?"), (1, None, "user", "q?"), (1, 4, "assistant", "Answer."),
        (2, 0, "user", "w " * 500_000 + "."), (2, 1, "assistant", ". " * 10), (3, 5, "user", "same."), (3, 5, "user", "same."), (3, 9, "user", "same."), (4, -3, "system", ""),
        *[(c, 0, "user", "Only a question?") for c in range(10, 60)],
    ]
    table = spark.createDataFrame([(*r, True, 1, "c", 2, "a") for r in rows], schema)
    check(table, rows)
    assert any(plain_rows(own)[0]["audit"] == "" for own in conversations_of(rows).values())
    audited, edited = repair.repair(table.limit(0))
    assert repair.repaired_digests(audited, edited).count() == edited.count() == 0


@pytest.mark.parametrize("n", [1, 3000])
def test_many_equal_rows_of_one_conversation(spark, n):
    rows = [(7, t, "assistant" if t % 2 else "user", "Said before.") for t in range(n)] + [(7, 10**6, "user", "tail")]
    audited, edited = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8))
    row = audited.first()
    kinds = [zlib.crc32(f"7:{t}".encode()) % 20 for t in range(n)]
    assert sum(c != "I" for c in row.audit) == sum({0: 0, 3: 2}.get(k, 1) for k in kinds) + {0: 0, 3: 2}.get(zlib.crc32(b"7:1000000") % 20, 1)
    assert row.duplicate >= 0.7 * n - 2 and edited.filter("place = 0").count() == 1
