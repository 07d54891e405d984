import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from fleetlens.llm import conversation, queries
from fleetlens.llm.conversation import Path, is_less

SF = "/root/testdata/sf0.001"
SHAPE = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    """{conv: rows after damage in order} of (conv, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest())
    return {c: sorted(v, key=order) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Whole strings per state, compared as they are: (cost, audit, repaired)."""

    states = {"": (0, "", ())}  # last role initial -> cost, audit, repaired
    rules = {"": "us", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def insert(states):
        out = dict(states)
        for last, (cost, audit, done) in states.items():
            for n in (1, 2):
                step, c, a, d = last, cost, audit, done
                for _ in range(n):
                    step = "a" if step == "u" else "u"
                    c, a, d = c + 2, a + "I", (*d, (names[step], ""))
                if step not in out or (c, a) < out[step][:2]:
                    out[step] = (c, a, d)
        return out

    for (_, role, text), fault in zip(rows, found, strict=True):
        after = {}

        def offer(last, *value, after=after):
            if last not in after or value[:2] < after[last][:2]:
                after[last] = value

        for last, (cost, audit, done) in insert(states).items():
            offer(last, cost + 3, audit + "D", done)
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            if role[:1] and role[:1] in rules[last]:
                offer(role[:1], cost + extra, audit + "K", (*done, (role, text)))
            for new in rules[last].replace("s", ""):
                offer(new, cost + 2 + extra, audit + "R", (*done, (names[new], text)))
        states = after
    ends = [v for k, v in insert(states).items() if k in ("", "a")]
    return min(ends, key=lambda v: v[:2])


def brute(rows):
    out = []
    for conv, kept in damage(rows).items():
        found = faults(kept)
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, done = cheapest(kept, found)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        assert SHAPE.match("".join(r[:1] for r, _ in done))
        out.append((conv, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def repaired(spark, rows, **options):
    schema = "conv_id long, turn long, role string, text string, print string, mark int, audit string"
    table = spark.createDataFrame([(*r, "p", 5, "x") for r in rows], schema)
    damaged = conversation.damaged(table)
    audit = conversation.audits(damaged, table, **options).cache()
    digest = {r.conv_id: r.repaired_sha256 for r in conversation.digests(damaged, audit).collect()}
    got = [(*r, digest[r.conv_id]) for r in audit.collect()]
    return sorted(got, key=repr), damaged, audit


def _odd_rows(seed=3, n=60):
    rng = np.random.Generator(np.random.PCG64(seed))
    texts = ["Yes.", "Yes.", "no", "why?", " \n", "", None, "long text without an end", "ok!", "é.", "two  \t"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "u2", "ärger"]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(int(rng.integers(1, 12))):
            row = (conv, None if rng.random() < 0.05 else int(turn + rng.integers(0, 3)), roles[rng.integers(len(roles))], texts[rng.integers(len(texts))])
            rows += [row] * int(rng.choice([1, 1, 1, 4]))
    return rows


def test_named_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, queries.op13_conversation_repair(spark, SF).collect()), key=repr)
    assert got == brute(rows) and len({r[7] for r in got}) > 3


def test_odd_rows_and_an_empty_table(spark):
    rows = _odd_rows()
    want = brute(rows)
    got, damaged, audit = repaired(spark, rows)
    assert got == want
    turns = {}
    for r in conversation.repaired_turns(damaged, audit).orderBy("conv_id", "place").collect():
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for row in want:
        assert hashlib.sha256("\n".join(turns.get(row[0], [])).encode()).hexdigest() == row[8]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation.audits(conversation.damaged(empty), empty).collect() == []


@pytest.mark.parametrize("roles", [["user", "assistant", "system"], ["tool"], ["user", "tool"]])
def test_long_conversations_are_chained_from_pieces(spark, roles):
    rng = np.random.Generator(np.random.PCG64(9))
    rows = [(c, t // 2, roles[rng.integers(len(roles))], f"text {rng.integers(60)}" + ".?x"[rng.integers(3)]) for c in (1, 2, 3) for t in range(150)]
    rows += rows[5:6] * 40
    got, _, _ = repaired(spark, rows, piece_rows=4)
    assert got == brute(rows)


def test_a_conversation_without_rows_left(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    got, _, _ = repaired(spark, [(7, gone, "user", "hello.")])
    assert got == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_paths_compare_as_their_strings(monkeypatch):
    rng = np.random.Generator(np.random.PCG64(4))
    paths = [Path(None, "")]
    for _ in range(400):
        parent = paths[rng.integers(len(paths))]
        block = "".join(rng.choice(list("DIKR"), int(rng.integers(1, 6))))
        paths.append(Path(parent, block))
    pairs = [(paths[a], paths[b]) for a, b in rng.integers(0, len(paths), (2000, 2))]
    for a, b in pairs:
        assert is_less(a, b) == (a.text() < b.text())
    # With a hash that cannot tell anything apart the letters still decide.
    monkeypatch.setattr(conversation, "extend_hash", lambda value, block: 0)
    for a, b in pairs:
        assert is_less(a, b) == (a.text() < b.text())
    monkeypatch.setattr(Path, "prefix_hash", lambda self, size: 0)
    for a, b in pairs:
        assert is_less(a, b) == (a.text() < b.text())
