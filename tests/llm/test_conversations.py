import hashlib
import itertools
import random
import re
import zlib

import pytest

from loomstone.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, dropped string, blank int"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = re.sub("[\x20\x09-\x0d]", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def after_damage(rows):
    """{conv_id: rows (turn, role, text) in order} of every conv_id."""
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def cheapest(rows):
    """Layer by layer over all rows, with the output itself as the state's last letters: another way than the agenda's."""
    marks = faults(rows)
    best = {"": (0, "", ())}  # by beginning's shape: '', 's', '..u', '..a'

    def shape(text):
        return text if text in ("", "s") else text[-1]

    def fits(text):
        return re.fullmatch("s?(ua)*u?", text) is not None

    def put(value, layer):
        text = "".join(x for x, _ in value[2])
        if fits(text) and ((k := shape(text)) not in layer or value[:2] < layer[k][:2]):
            layer[k] = value

    # all beginnings are kept with whatever was inserted last, so nothing is decided before the row is used
    for (_, role, text), mark in zip(rows, marks):
        after = {}
        layer = [v for v in best.values()]
        more = []
        for cost, audit, lines in layer:
            for k in range(3):
                for names in itertools.product(("user", "assistant"), repeat=k):
                    more.append((cost + 3 * k, audit + "I" * k, (*lines, *((n[0], n + ":") for n in names))))
        for cost, audit, lines in more:
            put((cost + 4, audit + "D", lines), after)
            if mark not in ("blank", "duplicate"):
                extra = 3 if mark == "truncated" else 0
                if role[:1] in ("s", "u", "a"):
                    put((cost + extra, audit + "K", (*lines, (role[0], f"{role}:{text}"))), after)
                for new in ("user", "assistant"):
                    put((cost + 3 + extra, audit + "R", (*lines, (new[0], f"{new}:{text}"))), after)
        best = after
    ends = []
    for cost, audit, lines in best.values():
        for k in range(3):
            for names in itertools.product(("user", "assistant"), repeat=k):
                got = (*lines, *((n[0], n + ":") for n in names))
                if re.fullmatch("(s?(ua)+)?", "".join(x for x, _ in got)):
                    ends.append((cost + 3 * k, audit + "I" * k, got))
    return min(ends, key=lambda x: x[:2])


def exhaustive(rows):
    """Every sequence of edits, with up to two insertions at each place."""
    marks = faults(rows)
    ways = [(0, "", ())]
    for (_, role, text), mark in [*zip(rows, marks), ((None, None, None), None)]:
        more = [(c + 3 * k, a + "I" * k, (*o, *((n[0], n + ":") for n in names))) for c, a, o in ways for k in range(3) for names in itertools.product(("user", "assistant"), repeat=k)]
        if role is None:
            ways = more
            break
        ways = [(c + 4, a + "D", o) for c, a, o in more]
        if mark not in ("blank", "duplicate"):
            extra = 3 if mark == "truncated" else 0
            ways += [(c + extra, a + "K", (*o, (role[:1], f"{role}:{text}"))) for c, a, o in more if role]
            ways += [(c + 3 + extra, a + "R", (*o, (n[0], f"{n}:{text}"))) for c, a, o in more for n in ("user", "assistant")]
        ways = [w for w in ways if re.fullmatch("s?(ua)*u?", "".join(x for x, _ in w[2]))]
    return min((w for w in ways if re.fullmatch("(s?(ua)+)?", "".join(x for x, _ in w[2]))), key=lambda w: w[:2])


def expected(rows, solve=cheapest):
    out = {}
    for conv, own in after_damage(rows).items():
        marks = faults(own)
        turns = [t for t, _, _ in own if t is not None]
        cost, audit, lines = solve(own)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(marks.count(x) for x in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own)),
            cost, audit, hashlib.sha256("\n".join(x for _, x in lines).encode()).hexdigest(),
        )
    return out


def got(df):
    rows = df.collect()
    out = {r[0]: tuple(r[1:9]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(C.op11_conversation_repair(spark, sf)) == expected(rows)


def random_rows(seed, convs, most):
    rnd = random.Random(seed)
    texts = ["Yes.", "No", "", " \t", "Why?", "Well!  ", "a. b", "é.", None, "Ja\x0b", "x　", "user"]
    roles = ["user", "assistant", "system", "tool", "sage", "", None]
    rows = []
    for conv in [*range(convs), None]:
        for t in range(rnd.randint(1, most)):
            rows.append((conv, rnd.choice([t, t, t, t + rnd.randint(0, 3), None]), rnd.choices(roles, [8, 8, 2, 1, 1, 1, 1])[0], rnd.choice(texts)))
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_against_all_edits(spark):
    rows = random_rows(1, 40, 4)
    assert got(C.repair(C.damaged(frame(spark, rows)))) == expected(rows, exhaustive)


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_against_layers(spark, chunk, monkeypatch):
    rows = random_rows(2, 60, 30)
    want = expected(rows)
    monkeypatch.setattr(C, "CHUNK_ROWS", chunk)  # workers get the function's globals, so results are made here as well
    assert got(C.repair(C.damaged(frame(spark, rows)))) == want
    for conv, own in after_damage(rows).items():
        talk, seen = C.Conversation(conv), set()
        for k, (turn, role, text) in enumerate(own):
            mark = faults(own[: k + 1])[-1]
            early = (role, text) in seen
            seen.add((role, text))
            talk.add(turn, role, text, mark == "blank", early, not re.search(r"[.!?][\x20\x09-\x0d]*\Z", text))
        assert talk.result()[1:] == want[conv]


def test_layers_agree_with_all_edits():
    rnd = random.Random(5)
    for _ in range(60):
        rows = [(t, rnd.choice(["user", "assistant", "system", "tool"]), rnd.choice(["Yes.", "No", "", "Why?"])) for t in range(rnd.randint(0, 5))]
        a, b = cheapest(rows), exhaustive(rows)
        assert a == b


def test_edges(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Hi."), (None, None, None, None), (2**53 + 1, -(2**63), "user", "Hi."), (2**53 + 1, 2**63 - 1, "user", "Hi!"), (7, 1, "user", "long. " * 50_000), (7, 1, "user", "long. " * 50_000)]
    out = got(C.repair(C.damaged(frame(spark, rows))))
    want = expected(rows)
    want[2**53 + 1] = (min(want[2**53 + 1][0], 2**63 - 1), *want[2**53 + 1][1:])
    assert out == want
    assert out[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert C.repair(C.damaged(frame(spark, rows).limit(0))).count() == 0


def test_a_long_conversation_is_streamed(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t % 1100}.") for t in range(2600)]
    out = got(C.repair(C.damaged(frame(spark, rows))))
    assert out == expected(rows)
