import hashlib
import random
import re
import zlib
from functools import lru_cache

from dayloom.llm import conversations
from dayloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def damaged(rows):
    """Brute force: the rows of every conversation after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        turns = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        turns += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(t, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, t in out.items()}


def repaired(rows):
    """Brute force: suffixes of edits, cheapest first, then in their order."""
    seen, symbols = set(), []
    count = {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        bare = text.strip(BLANKS)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        symbols.append((role[:1], fault))
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, last, inserts=0):
        found = []
        if i == len(symbols) and last in ("", "a"):
            found.append((0, ""))
        if inserts < 4:
            rest = best(i, follows[last], inserts + 1)
            if rest:
                found.append((rest[0] + 5, "I" + rest[1]))
        if i < len(symbols):
            initial, fault = symbols[i]
            options = [("D", 2, last)]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault else 0
                if initial == follows[last] or (initial, last) == ("s", ""):
                    options.append(("K", extra, initial))
                options.append(("R", 1 + extra, follows[last]))
            for letter, cost, after in options:
                rest = best(i + 1, after)
                if rest:
                    found.append((cost + rest[0], letter + rest[1]))
        return min(found) if found else None

    for i in range(len(symbols), 0, -1):  # from the end, so that no recursion is deep
        for last in follows:
            best(i, last)
    cost, audit = best(0, "")
    turns, i, last = [], 0, ""
    for letter in audit:
        if letter == "I":
            last = follows[last]
            turns.append(({"u": "user", "a": "assistant"}[last], ""))
            continue
        _, role, text = rows[i]
        i += 1
        if letter == "R":
            role = {"u": "user", "a": "assistant"}[follows[last]]
        if letter != "D":
            last = role[:1]
            turns.append((role, text))
    known = [r[0] for r in rows if r[0] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:], strict=False))
    text = "\n".join(f"{r}:{t}" for r, t in turns)
    return (gaps, *count.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def report(rows):
    out = conversations.conversation_report(conversations.repair_conversations(rows))
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[n] for n in names[1:]) for r in out.select(*names).collect()}


def some_rows(seed, n, roles, texts):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(n)]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(8 * n)]


ROLES = ["user", "user", "assistant", "assistant", "system", "tool", None, ""]
TEXTS = ["Yes.", "No!", "Why?", "cut off", "", None, " \t", "one more. ", "a ", " ", "é.", "x" * 3000 + "."]


def test_reports_agree_with_brute_force(spark):
    rows = some_rows(3, 60, ROLES, TEXTS) + [(1000 + k, k % 5, "user", f"text {k}.") for k in range(40)] + [(5000, 7, None, None)]
    random.Random(4).shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("text", "text")
    out = report(conversations.damage(table.selectExpr("*", "'own' AS audit", "1 AS cost").repartition(3)))
    assert out == {c: repaired(t) for c, t in damaged(rows).items()}


def test_long_conversations_are_put_together_from_pieces(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(7, t, rng.choice(ROLES), rng.choice(TEXTS[:4] + [f"turn {t}.", f"turn {t}"])) for t in range(900)]
    rows += [(8, None, "user", "Same."), (8, None, "user", "Same.")] * 200 + [(9, t, "user", "Hi.") for t in range(30)] + [(6, 0, "user", "Hi.")]
    monkeypatch.setattr(conversations, "ROWS", 16)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = report(conversations.damage(table))
    assert out == {c: repaired(t) for c, t in damaged(rows).items()}


def test_nothing_and_general_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert report(conversations.damage(empty)) == {}
    plain = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."), (2, 0, "assistant", "Hi.")], "conv_id long, turn long, role string, text string")
    out = conversations.repair_conversations(plain).collect()
    assert sorted((r["conv_id"], r["audit"], [tuple(t) for t in r["repaired"]]) for r in out) == [
        (1, "KK", [("user", "Hi."), ("assistant", "Hello.")]), (2, "D", []),
    ]


def test_trails_compare_as_their_strings_also_with_colliding_hashes(monkeypatch):
    for modulus in ((1 << 61) - 1, 3):  # with three hash values nearly everything collides
        monkeypatch.setattr(conversations, "_MOD", modulus)
        rng = random.Random(5)
        trail, strings = conversations.Trail(), [""]
        for _ in range(300):
            parent, letter = rng.randrange(len(strings)), rng.choice("DIKR")
            trail.add(parent, letter)
            strings.append(strings[parent] + letter)
        for _ in range(4000):
            a, b = rng.randrange(len(strings)), rng.randrange(len(strings))
            if strings[a] != strings[b]:
                assert trail.less(a, b) == (strings[a] < strings[b])


def test_query_on_a_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = QUERIES["op13_conversations"](spark, SMALL).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert {r["conv_id"]: tuple(r[n] for n in names) for r in out} == {c: repaired(t) for c, t in damaged(rows).items()}
