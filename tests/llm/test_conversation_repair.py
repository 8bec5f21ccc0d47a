import functools
import hashlib
import random
import re
import zlib

from voltlake.llm import conversation_repair as C


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        m = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if m == 0:
            continue
        text = "" if m == 1 else re.sub("[.!?]", "", text) if m == 2 else text
        out += [(conv, turn, "user" if m == 4 else role, text)] * (2 if m == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit) by trying every edit; rows: (role, fault)."""

    @functools.cache
    def go(k, state, inserted):
        found = [(0, "", ())] if k == len(rows) and state in "0a" else []
        due = "assistant" if state == "u" else "user"
        if inserted < 3:
            c, a, r = go(k, due[0], inserted + 1)
            found.append((c + 3, "I" + a, ((due, None), *r)))
        if k < len(rows):
            role, fault = rows[k]
            c, a, r = go(k + 1, state, 0)
            found.append((c + 4, "D" + a, r))
            if fault in ("", "truncated"):
                late = 3 * (fault == "truncated")
                c, a, r = go(k + 1, due[0], 0)
                found.append((c + 3 + late, "R" + a, ((due, k), *r)))
                if role[:1] == due[0] or role[:1] == "s" and state == "0":
                    c, a, r = go(k + 1, role[:1], 0)
                    found.append((c + late, "K" + a, ((role, k), *r)))
        return min(found, default=(10**9, "", ()))

    for k in range(len(rows), 0, -1):  # so that no call goes deep
        for state in "0sua":
            go(k, state, 0)
    return go(0, "0", 0)


def brute(rows):
    out = {}
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in after if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        cost, audit, lines = cheapest(tuple((r[1], f) for r, f in zip(own, faults, strict=True)))
        said = "\n".join(f"{role}:{'' if k is None else own[k][2]}" for role, k in lines)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def made(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, kind int").repartition(3)
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in C.repair(C.damaged(df)).collect()}


def test_against_trying_every_edit(spark):
    rng = random.Random(1)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "agent"], ["Yes.", "No!", "well", "", None, "  \t", "A longer one. And so", "Ünï?\n ", "Yes."]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(150) for t in range(rng.randrange(1, 8))]
    rows += [(200, None, "user", "Hi."), (200, None, "assistant", "Ho"), (200, 5, "user", "Hi."), (None, 1, "user", "One."), (None, 9, "assistant", "Two."), (201, None, None, None)]
    rows += [rows[4], rows[4], (202, 1, "user", "a" * 200_000), (202, 2, "assistant", " " * 200_000), (-5, -3, "user", "x?"), (-5, 4, "assistant", "y?")]
    assert made(spark, rows) == brute(rows)


def test_long_conversation(spark):
    """A third of all rows in one, as many rows equal."""
    rng = random.Random(2)
    rows = [(1, k, "user" if k % 2 else "assistant", f"{rng.choice(['Yes', 'No'])} {k}{rng.choice(['.', ''])}") for k in range(400)] + [(2, 1, "user", "Hello.")] * 400
    rows += [(k, t, rng.choice(["user", "assistant", "system"]), f"{t}.") for k in range(3, 100) for t in range(4)]
    assert made(spark, rows) == brute(rows)


def test_nodes_are_built_once():
    """Signatures sorted from their ends build each distinct end once, and give what each alone gives."""
    rng = random.Random(3)
    signatures = sorted({"".join(rng.choice("suaoSUAO-") for _ in range(rng.randrange(12))) for _ in range(3000)}, key=lambda s: s[::-1])
    together = C.Automaton()
    assert [together.audit(s) for s in signatures] == [C.Automaton().audit(s) for s in signatures]
    assert together.built == len({s[k:] for s in signatures for k in range(len(s))})
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for s in signatures[::7]:
        want = cheapest(tuple(("user", "blank") if c == "-" else (names[c.lower()], "truncated" if c.isupper() else "") for c in s[:9]))
        assert C.Automaton().audit(s[:9]) == want[:2]


def test_empty(spark):
    assert made(spark, []) == {}
