"""Operator 13 against a search over all edits and its SQL, and its edge cases."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pytest

from clausewise.llm import queries, turns

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(symbols):
    """(cost, audit, outputs) by a search that takes the cheapest, then least, unfinished audit first."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, roles, out = heapq.heappop(heap)
        if k == len(symbols) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit, out
        state = (k, roles[-1:] if len(roles) else "", len(roles) > 0)
        if (state, audit) in done or not re.fullmatch(r"s?(ua)*u?", roles):
            continue
        done.add((state, audit))
        for r in "ua":
            if len(audit) < 2 * len(symbols) + 3:
                heapq.heappush(heap, (cost + 2, audit + "I", k, roles + r, (*out, ("I", r, k))))
        if k < len(symbols):
            role, fault = symbols[k]
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, roles, out))
            if fault in "kt":
                extra = fault == "t"
                heapq.heappush(heap, (cost + extra, audit + "K", k + 1, roles + role, (*out, ("K", role, k))))
                for r in "ua":
                    heapq.heappush(heap, (cost + 2 + extra, audit + "R", k + 1, roles + r, (*out, ("R", r, k))))
    raise AssertionError


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub(r"[.!?]", "", text) if k == 2 else text
        out += [] if k == 0 else [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def brute(rows, all_ids, audits=cheapest):
    out, memo = [], {}
    for conv in all_ids:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        symbols, seen = [], set()
        for _, role, text in own:
            bare = re.sub(r"[\x20\x09-\x0D]", " ", text).rstrip(" ")
            fault = "b" if not bare else "d" if (role, text) in seen else "k" if bare[-1] in ".!?" else "t"
            seen.add((role, text))
            symbols.append((role[0] if role and role[0] in "sua" else "o", fault))
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        key = tuple(symbols)
        cost, audit, made = memo.get(key) or memo.setdefault(key, audits(symbols))
        role = {"u": "user", "a": "assistant"}
        text = "\n".join(f"{own[k][1]}:{own[k][2]}" if e == "K" else f"{role[r]}:{own[k][2] if e == 'R' else ''}" for e, r, k in made)
        out.append((conv, gaps, *(sum(f == x for _, f in symbols) for x in "bdt"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def shown(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_op13_solves_every_short_signature():
    for n in range(4):
        for symbols in itertools.product(itertools.product("suao", "ktd"), repeat=n):
            assert turns.solve("".join(turns.letter(*s) for s in symbols)) == cheapest(list(symbols))[:2], symbols


def test_op13_solves_longer_signatures():
    rng = random.Random(2)
    for _ in range(150):
        symbols = [(rng.choice("suua" "ao"), rng.choice("kkktbd")) for _ in range(rng.randrange(4, 9))]
        assert turns.solve("".join(turns.letter(*s) for s in symbols)) == cheapest(symbols)[:2], symbols
    cost, audit = turns.solve(turns.letter("u", "k") * 30_000)
    assert cost == 30_000 and sorted(set(audit)) in (["K", "R"], ["I", "K", "R"]) and len(audit.replace("I", "")) == 30_000


def conversations(seed=1):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 7)):
            turn = turn * rng.choice([1, 1, 1, 2]) if rng.random() < 0.9 else None
            rows.append((conv, turn, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice(["Yes.", "No!  ", "Well? \n", "cut off", " ", "", None, "same.", "same.", "Größe…"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bounds", [(1024, 1 << 20, 32 << 20), (2, 1 << 20, 0), (1024, 5, 0)])
def test_op13_equals_a_search_over_all_edits(spark, monkeypatch, bounds):
    """With chunks of two turns or five bytes most conversations are open and have several chunks; without a broadcast signatures are dealt."""
    for name, value in zip(("CHUNK_ROWS", "CHUNK_BYTES", "BROADCAST_BYTES"), bounds, strict=True):
        monkeypatch.setattr(turns, name, value)
    rows = conversations()
    given = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, cid int").repartition(3)
    ids = {r[0] for r in rows}
    assert shown(turns.with_all(turns.report(turns.damage(given)), given)) == brute(damaged(rows), ids)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert shown(turns.report(given)) == brute(plain, ids)


def test_op13_spreads_one_long_conversation(spark, monkeypatch):
    """One conversation has nearly all rows, and repeats that lie in other tasks; it is compared with the same solver, whole."""
    monkeypatch.setattr(turns, "CHUNK_ROWS", 50)
    rng = random.Random(9)
    rows = [("long", k, "user" if k % 2 == 0 else "assistant", f"turn {k % 700}." if rng.random() < 0.9 else "oh") for k in range(1500)] + [("short", 1, "user", "Hi."), ("short", 2, "assistant", "Hi.")]
    given = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")

    def solved(symbols):
        cost, audit = turns.solve("".join(turns.letter(*s) for s in symbols))
        out, k = [], 0
        for e in audit:
            if e != "D":
                out.append((e, "ua"[len(out) % 2], k))
            k += e != "I"
        return cost, audit, out

    found = turns.report(given)
    assert shown(found) == brute(rows, {"long", "short"}, solved)
    turned = turns.repaired(given).filter("conv_id = 'long'").orderBy("pos").collect()
    text = "\n".join(f"{r['role']}:{r['text']}" for r in turned)
    assert [r["pos"] for r in turned] == list(range(len(turned)))
    assert hashlib.sha256(text.encode()).hexdigest() == found.filter("conv_id = 'long'").first()["repaired_sha256"]
    assert re.fullmatch("(ua)+", "".join(r["role"][0] for r in turned))


def test_op13_empty_tables_and_conversations_that_lose_all(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.with_all(turns.report(turns.damage(none)), none).count() == 0
    gone = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert shown(turns.with_all(turns.report(turns.damage(one)), one)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op13_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('/root/testdata/{sf}/conversations.parquet')")
    assert shown(queries.op13_conversation_repair(spark, f"/root/testdata/{sf}")) == sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({turns.SQL})").fetchall(), key=repr)
