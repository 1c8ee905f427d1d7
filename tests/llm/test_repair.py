"""Conversation repair against an exhaustive search over edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from penawar.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """Best-first search over (cost, audit): rows are (role, text, gone, truncated). Returns (cost, audit, lines)."""
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        state = roles[-1:] if len(roles) > 1 else roles  # what may follow depends on the last role and on a leading s
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and GRAMMAR.fullmatch(roles):
            return cost, audit, list(lines)

        def go(extra, letter, step, role=None, line=None):
            new = roles + (role or "")
            if role and not re.fullmatch(r"s?(ua)*u?", new):
                return
            heapq.heappush(heap, (cost + extra, audit + letter, i + step, new, lines + ((line,) if line is not None else ())))

        for name in ("user", "assistant"):
            go(3, "I", 0, name[0], f"{name}:")
        if i < len(rows):
            role, text, gone, cut = rows[i]
            go(4, "D", 1)
            if not gone:
                if role[:1] in ("s", "u", "a"):
                    go(3 * cut, "K", 1, role[0], f"{role}:{text}")
                for name in ("user", "assistant"):
                    go(3 + 3 * cut, "R", 1, name[0], f"{name}:{text}")


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for c, mine in convs.items():
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, marked, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            body = text.rstrip("\x20\t\n\x0b\x0c\r")
            kind = ("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
            if kind:
                n[kind] += 1
            marked.append((role, text, kind in ("blank", "duplicate"), kind == "truncated"))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, lines = cheapest(marked)
        out.append((str(c), gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r.conv_id), *r[1:]) for r in df.collect())


def turns_of(seed, convs, most):
    rng = random.Random(seed)
    texts = ["Fine.", "Cut here", "", " \n", "Really? ", "no", "So!\t", "x" * 50]
    rows = []
    for c in range(convs):
        for _ in range(rng.randrange(most + 1)):
            rows.append((c, rng.choice([None, *range(6)]) if rng.random() < 0.3 else rng.randrange(12),
                         rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]), rng.choice([*texts, f"t{rng.randrange(99)}.", None])))
    return rows


@pytest.mark.parametrize("piece_rows", [2, 256])
def test_edits_equal_exhaustive_search(spark, piece_rows):
    rows = turns_of(piece_rows, 60, 9)
    rows += [(None, 1, "user", "Hello."), (None, None, "assistant", "Hi."), (77, 4, "user", "Same."), (77, 4, "user", "Same."), (77, 4, "user", "Same.")]
    got = repair.repair(spark.createDataFrame(rows, SCHEMA), piece_rows=piece_rows)
    assert result(got) == brute(rows)


def test_one_long_conversation_over_many_pieces(spark):
    """A conversation that holds nearly all rows, cut into pieces of 7 rows over several partitions."""
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"a{t}.", f"b{t}", "", "Same."])) for t in range(400)]
    rows += [(2, 1, "user", "Hi."), (2, 2, "assistant", "Ho.")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = repair.repair(df, piece_rows=7)
    assert result(got) == brute(rows)
    pieces = sorted(repair.repaired_pieces(df, piece_rows=7).where("conv_id = 1").collect(), key=lambda r: (r.part, r.no))
    assert len(pieces) >= 57 and len({p.part for p in pieces}) > 1
    lines = "\n".join(line for p in pieces for line in p.lines)
    (sha,) = [r[-1] for r in brute(rows) if r[0] == "1"]
    assert hashlib.sha256(lines.encode()).hexdigest() == sha


def test_damage_and_conversations_without_rows(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", f"Turn {t}! Of {c}.") for c in range(80) for t in range(1, 4)]
    rows += [(500, None, None, None), (None, None, "user", "Yes.")]
    bad = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
        bad += [(c, t, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    want = dict((r[0], r) for r in brute(bad))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = sorted(want.get(str(c), (str(c), *empty)) for c in {r[0] for r in rows})
    assert result(repair.repair_damaged(spark.createDataFrame(rows, SCHEMA))) == want


def test_all_rows_of_a_conversation_dropped(spark):
    gone = [c for c in range(4000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (1,))][:3]
    df = spark.createDataFrame([(c, 1, "user", "Hi.") for c in gone], SCHEMA)
    assert [tuple(r[1:8]) for r in repair.repair_damaged(df).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair(empty).collect() == [] and repair.repair_damaged(empty).collect() == []
    far = [(1, -2**63, "user", "A."), (1, 2**63 - 1, "assistant", "B."), (2, None, "user", "y" * 3_000_000 + "."), (2, None, "assistant", "C.")]
    clash = spark.createDataFrame([(*r, 1, "x", 2) for r in far], SCHEMA + ", part int, fault string, cost long")
    got = {r.conv_id: r for r in repair.repair(clash).collect()}
    assert got[1].gaps is None and got[1].audit == "KK"  # more gaps than 64 bits can count
    # by role within one turn: assistant first
    assert got[2].gaps == 0 and got[2].cost == 6 and got[2].audit == "IKKI"


def test_grammar_tables():
    """Every signature of up to four symbols: the table's best audit gives a legal sequence of roles."""
    for n in range(5):
        for sig in itertools.product("suaoSUAx", repeat=n):
            node = repair.empty_suffix()
            for symbol in reversed(sig):
                node = repair.longer_suffix(symbol, node)
            cost, audit = min(node[0][r] for r in repair.ENDS if node[0][r])
            roles = ["system" if s in "sS" else "user" if s in "uU" else "assistant" if s in "aA" else "other" for s in sig]
            lines = repair.repaired_lines(roles, ["t"] * n, audit, 0)
            assert GRAMMAR.fullmatch("".join(x[0] for x in lines))
            if n <= 3:
                assert (cost, audit) == cheapest([(r, "t", s == "x", s.isupper()) for r, s in zip(roles, sig)])[:2]
