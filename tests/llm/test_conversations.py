"""Prefix tries and repairs of conversations against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import prefixes, repair
from ledgerlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, depth int, n_convs string, fault double"


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _crc(text):
    return zlib.crc32(text.encode())


def _odd_rows(seed=1, n=60):
    """Short conversations of few different turns, with nulls, ties, repeated and missing turns."""
    rng, rows = random.Random(seed), []
    for conv in rng.sample(range(200), n):
        texts = rng.choice([["hi there.", "a b"], ["hi there.", None, ""], ["x", " \n", "hi there."]])
        for turn in range(rng.choice([1, 2, 2, 3, 5])):
            for _ in range(rng.choice([1, 1, 1, 2])):
                rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", "user", "system", None, "tool", ""]), rng.choice(texts)))
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    rows = _odd_rows()
    return spark.createDataFrame([(*r, 1, "n", 2.0) for r in rows], SCHEMA).repartition(3), rows


def _collected(df):
    return [(r.conv_id, r.turn, r.role, r.text) for r in df.select("conv_id", "turn", "role", "text").collect()]


def _hash(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def _ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v, key=lambda x: (*x[:3], _hash(*x[2:])))] for c, v in convs.items()}


def _rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = _crc(str(c)) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def _trie(convs):
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        gain = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += gain
            leaves[p[:d]] += not children[p]
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        yield min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], _sha(ends)


def _nodes(df):
    return Counter(tuple(r[c] for c in prefixes.NODE) for r in df.collect())


def test_trie_of_odd_rows(odd):
    turns, rows = odd
    convs = _ordered(rows)
    assert _nodes(prefixes.trie(prefixes.rebuilt(turns))) == Counter(_trie(_rebuilt(convs)))
    assert _nodes(prefixes.trie(prefixes.paths(turns))) == Counter(_trie(convs))


def test_trie_query(spark):
    rows = _collected(spark.read.parquet(f"{SF}/conversations.parquet"))
    assert _nodes(QUERIES["op11_prefix_trie"](spark, SF)) == Counter(_trie(_rebuilt(_ordered(rows))))


def test_trie_of_a_sketch_that_is_full(odd):
    """A sketch that proves next to nothing leaves the result as it is."""
    turns, rows = odd
    assert _nodes(prefixes.trie(prefixes.paths(turns), widest=64)) == Counter(_trie(_ordered(rows)))


def test_trie_of_copies_and_a_conversation_over_many_ranges(spark):
    """One conversation of a third of all rows with a copy, and many copies of a short one; each lies in several partitions."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        long = [(c, t, "user", f"w{t % 7} x") for c in (7, 140) for t in range(300)]
        rows = long + [(140, 300, "user", "more")] + [(c, t, "user", "same words") for c in range(200, 400) for t in range(2)] + [(None, 1, "user", "x")]
        turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
        assert prefixes.numbered(turns).where("conv_id = 7").select(F.countDistinct("a"), F.max("k")).first() == (300, 300)
        convs = _ordered(rows)
        assert _nodes(prefixes.trie(prefixes.paths(turns))) == Counter(_trie(convs))
        assert _nodes(prefixes.trie(prefixes.rebuilt(turns))) == Counter(_trie(_rebuilt(convs)))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_trie_of_turnless_conversations_and_no_rows(spark, odd):
    convs = [c for c in range(1, 400) if _crc(str(c)) % 4 == 3 and c % 20][:3]
    turns = spark.createDataFrame([(c, 0, "user", "x") for c in convs], "conv_id long, turn long, role string, text string")
    found = prefixes.trie(prefixes.rebuilt(turns)).collect()
    assert [tuple(r) for r in found] == [(convs[0], 0, None, 3, 0, 1, 0, _sha(",".join(map(str, convs))))]
    assert prefixes.trie(prefixes.rebuilt(odd[0].limit(0))).count() == 0


def _best(turns):
    """The cheapest (cost, audit), by going through all edits of each turn and up to two inserts at each place."""
    layer = {"": {(0, "")}}  # output initials so far, cut to what matters
    inserts = ["", "I", "II"]

    def grown(state, more):
        out = state
        for x in more:
            ok = {"": "su", "s": "u", "u": "a", "a": "u"}[out]
            if x not in ok:
                return None
            out = x
        return out

    def options(initial, fault):
        yield 4, "D", [""]
        if fault not in ("blank", "duplicate"):
            extra = 3 if fault == "truncated" else 0
            yield extra, "K", [initial]
            yield 3 + extra, "R", ["u", "a"]

    def put(table, state, entry):
        table.setdefault(state, set()).add(entry)

    def inserted(table):
        out = {}
        for state, entries in table.items():
            for text in inserts:
                for roles in itertools.product("ua", repeat=len(text)):
                    to = grown(state, roles)
                    if to is not None:
                        for cost, audit in entries:
                            put(out, to, (cost + 3 * len(text), audit + text))
        return {s: {min(e)} for s, e in out.items()}

    for initial, fault in turns:
        after = {}
        for state, entries in inserted(layer).items():
            for cost, edit, outs in options(initial, fault):
                for o in outs:
                    to = grown(state, o) if o in ("", "s", "u", "a") else None
                    if to is not None:
                        for c, audit in entries:
                            put(after, to, (c + cost, audit + edit))
        layer = after
    last = inserted(layer)
    return min(min(last[s]) for s in ("", "a") if s in last)


def test_search_finds_the_least_of_all():
    rng = random.Random(3)
    for _ in range(1500):
        turns = [(rng.choice("suaut?"), rng.choice(repair.FAULTS + ("",))) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 12]))]
        assert repair.search(turns) == _best(turns), turns


def test_search_of_all_edit_strings():
    """Against every string of edits, up to three turns."""
    rng = random.Random(4)
    for _ in range(60):
        turns = [(rng.choice("suat"), rng.choice(repair.FAULTS + ("",))) for _ in range(rng.choice([1, 2, 3]))]
        found = []
        for n in range(len(turns), len(turns) + 4):
            for edits in itertools.product("DIKR", repeat=n):
                if sum(e != "I" for e in edits) != len(turns):
                    continue
                for roles in itertools.product("ua", repeat=sum(e in "IR" for e in edits)):
                    cost, out, left, at = 0, "", iter(roles), iter(turns)
                    for e in edits:
                        if e == "I":
                            cost, out = cost + 3, out + next(left)
                            continue
                        initial, fault = next(at)
                        if e == "D":
                            cost += 4
                            continue
                        cost += (3 if e == "R" else 0) + (3 if fault == "truncated" else 0) + (999 if fault in ("blank", "duplicate") else 0)
                        out += next(left) if e == "R" else initial
                    if re.fullmatch("(s?(ua)+)?", out):
                        found.append((cost, "".join(edits)))
        assert repair.search(turns) == min(found), turns


def test_long_search_ends():
    rng = random.Random(5)
    turns = [(rng.choice("ua"), rng.choice(["", "", "truncated", "blank"])) for _ in range(20_000)]
    assert repair.search(turns)[0] > 0


def _damaged(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].extend([])
        kind = _crc(f"{' ' if c is None else c}:{' ' if turn is None else turn}") % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            convs[c] += [(turn is not None, turn or 0, "user" if kind == 4 else role, text, turn)] * (2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda x: x[:4]) for c, v in convs.items()}


def _repairs(rows):
    for c, turns in _damaged(rows).items():
        seen, faults = set(), []
        for _, _, role, text, _ in turns:
            words = text.strip("\x20\t\n\x0b\x0c\r")
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[:1] for _, _, r, _, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = _best([(i or "?", f) for i, f in zip(initials, faults)])
        out, at = [], iter(turns)
        for e in audit:
            _, _, role, text, _ = next(at) if e != "I" else (0, 0, "", "", 0)
            if e in "IR":
                role = "assistant" if out and out[-1][0][:1] == "u" else "user"
            if e != "D":
                out.append((role, text))
        numbers = [t for *_, t in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        yield c, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, _sha("\n".join(f"{r}:{t}" for r, t in out))


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _repaired(turns, **more):
    return Counter(tuple(r[c] for c in COLUMNS) for r in repair.with_all(repair.repaired(repair.damaged(turns), **more), turns).collect())


def test_repairs_of_odd_rows(spark, odd):
    turns, rows = odd
    more = rows + [(None, 3, "user", "null id."), (None, 1, None, "no role"), (501, 1, "user", "w " * 50_000 + "."), (501, 2, "assistant", "ok!")]
    turns = turns.select("conv_id", "turn", "role", "text").union(spark.createDataFrame(more[len(rows) :], "conv_id long, turn long, role string, text string"))
    wanted = Counter(_repairs(more))
    assert _repaired(turns) == wanted
    assert _repaired(turns, held=12) == wanted  # most hashes by the streaming pass
    assert not _repaired(turns.limit(0))


def test_repair_query(spark):
    rows = _collected(spark.read.parquet(f"{SF}/conversations.parquet"))
    found = Counter(tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_structure_repair"](spark, SF).collect())
    assert found == Counter(_repairs(rows))


def test_conversations_of_which_nothing_is_left(spark):
    gone = next(c for c in range(1000) if _crc(f"{c}:0") % 20 == 0)
    turns = spark.createDataFrame([(gone, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert list(_repaired(turns)) == [(gone, 0, 0, 0, 0, 0, 0, "", _sha(""))]
