"""Repairing the structure of conversations: which turns to keep, rename, delete or insert, at least cost.

A turn is a letter for its role's initial and its fault, so a conversation is a string, its
signature, and many conversations have the same one. Each distinct signature is solved once; the
cheapest edits (the audit) are joined back and replayed on the turns.

Turns are dealt by ranges of (conversation, turn) and packed into chunks of bounded size, so a
conversation of any length is spread over tasks. What lies wholly inside a task is judged there. A
conversation that may go on in another task is open: its repeats across chunks are found by
joining digests, its chunks' letters and audits are put together and cut again, and only the bytes
of its repaired text pass one task, in order, for their digest.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesops, graph

#: Turns and bytes of a chunk; bytes of solved signatures that are broadcast; shares of rows above which a signature is
#: hot, and parts that a hot one is dealt to.
CHUNK_ROWS, CHUNK_BYTES, BROADCAST_BYTES, HOT, PARTS = 1024, 1 << 20, 32 << 20, 1e-3, 64
ROLES, FAULTS, SPACE, ENDS = "suao", "ktbd", " \t\n\v\f\r", ".!?"
#: The roles that may follow (nothing, s, u, a), each with the state it leads to.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
INSERT, RENAME, DELETE, CUT_OFF = 2, 2, 3, 1
Edits = dict[tuple[int, int], tuple[int, str]]


def letter(role: str, fault: str) -> str:
    return chr(65 + 4 * ROLES.index(role if role in ROLES[:3] and role else "o") + FAULTS.index(fault))


def _inserts() -> Edits:
    """Ways from state to state by insertions alone; a third one would only close a circle."""
    out = {(q, q): (0, "") for q in range(4)}
    for _ in range(2):
        for (p, q), (cost, text) in list(out.items()):
            for role, r in NEXT[q].items():
                if role != "s":
                    out[p, r] = min(out.get((p, r), (1 << 60, "")), (cost + INSERT, text + "I"))
    return out


def _joined(a: Edits, b: Edits) -> Edits:
    """The cheapest ways through a and then b, and of these the least text. Of two ways through a with the same ends and cost
    neither text begins the other (both have one edit for each turn), so the least ways of the parts make the least whole."""
    out: Edits = {}
    for (p, q), (cost, text) in a.items():
        for r in range(4):
            if (way := b.get((q, r))) is not None and (found := (cost + way[0], text + way[1])) < out.get((p, r), (1 << 60, "")):
                out[p, r] = found
    return out


def _turn(x: str) -> Edits:
    """Ways past one turn, with insertions before it."""
    role, fault = ROLES[(ord(x) - 65) // 4], FAULTS[(ord(x) - 65) % 4]
    own: Edits = {(q, q): (DELETE, "D") for q in range(4)}
    if fault in "kt":
        extra = CUT_OFF if fault == "t" else 0
        for q in range(4):
            for to, r in NEXT[q].items():
                if to == role:
                    own[q, r] = (extra, "K")
                elif to != "s":
                    own[q, r] = (RENAME + extra, "R")
    return _joined(_INSERTS, own)


_INSERTS = _inserts()


def _ways(signature: str) -> Edits:
    """Ways past the turns of a signature, by recursion on two parts; the first is the largest power of two, so that parts recur."""
    if len(signature) > 64:
        cut = 1 << (len(signature) - 1).bit_length() - 1
        return _joined(_ways(signature[:cut]), _ways(signature[cut:]))
    return _short(signature)


@functools.lru_cache(maxsize=20_000)
def _short(signature: str) -> Edits:
    if not signature:
        return {(q, q): (0, "") for q in range(4)}
    if len(signature) == 1:
        return _turn(signature)
    cut = 1 << (len(signature) - 1).bit_length() - 1
    return _joined(_short(signature[:cut]), _short(signature[cut:]))


def solve(signature: str) -> tuple[int, str]:
    """The least cost of making the roles s?(ua)+ or nothing, and the initials of its edits, the ASCII-least ones."""
    ways = _joined(_ways(signature), _INSERTS)
    return min(ways[0, q] for q in (0, 3) if (0, q) in ways)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults that follow from crc32("conv_id:turn") modulo 20: 0 drops the row, 1 empties its text,
    2 takes its .!? away, 3 repeats it, 4 makes its role user. Nulls of role and text, and of the ids in the sum, are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), k.alias("k")).filter("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def _order(rows: DataFrame) -> DataFrame:
    filled = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return filled.withColumn("digest", digest).repartitionByRange("conv_id", "turn", "digest").sortWithinPartitions("conv_id", "turn", "digest")


def _chunks(rows: DataFrame) -> DataFrame:
    """cid (in order of conversations and turns), conv_id, open, sig, low, high, different (of turns), roles, texts, and for open ones the
    digest of each turn that is sound and new to its task."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cid, conv, seen, turns, at = TaskContext.get().partitionId() << 32, (), set(), [], 0
        first, several, held = True, False, 0

        def flush(of: pa.DataType, open_: bool) -> pa.RecordBatch:
            whole = [t[0] for t in turns if t[0] is not None]
            arrays = [pa.array([cid], pa.int64()), pa.array(list(conv), of), pa.array([open_]), pa.array(["".join(t[3] for t in turns)])]
            arrays += [pa.array([x], pa.int64()) for x in (min(whole, default=None), max(whole, default=None), len(set(whole)))]
            arrays += [pa.array([[t[1] for t in turns]], pa.list_(pa.string())), pa.array([[t[2] for t in turns]], pa.list_(pa.string())), pa.array([[t[4] for t in turns] if open_ else []], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(arrays, ["cid", "conv_id", "open", "sig", "low", "high", "different", "roles", "texts", "digests"])

        of = None
        for b in bytesops.batches(source):
            of = b.column(0).type
            for key, turn, role, text, digest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key,) != conv and turns:
                    yield flush(of, first or several)
                    first = several = False
                    cid, turns, held, seen = cid + 1, [], 0, set()
                elif len(turns) >= CHUNK_ROWS or held + len(text) > CHUNK_BYTES and turns:
                    several = True
                    yield flush(of, True)
                    cid, turns, held = cid + 1, [], 0
                conv, bare = (key,), text.rstrip(SPACE)
                fault = "b" if not bare else "d" if digest in seen else "k" if bare[-1] in ENDS else "t"
                seen.add(digest)
                turns.append((turn, role, text, letter(role[:1], fault), digest if fault in "kt" else None))
                held += len(text)
        if turns:  # the last conversation may go on in the next task, as the first one may have begun in another
            yield flush(of, True)

    schema = f"cid bigint, conv_id {kind}, open boolean, sig string, low bigint, high bigint, different bigint, roles array<string>, texts array<string>, digests array<binary>"
    return _order(rows).withColumn("turn", F.col("turn").cast("bigint")).mapInArrow(pack, schema)


def _whole(chunks: DataFrame) -> DataFrame:
    """key, cids, counts, sig, gaps of each conversation with open chunks; key is the least cid."""
    turns = chunks.select("cid", "conv_id", F.posexplode("digests").alias("pos", "digest")).filter("digest IS NOT NULL")
    first = turns.groupBy("conv_id", "digest").agg(F.min("cid").alias("home"), F.count("*").alias("n")).filter("n > 1")
    first = first.select(F.col("conv_id").alias("conv"), F.col("digest").alias("d"), "home")
    late = turns.join(first, [F.col("digest") == F.col("d"), F.col("conv_id").eqNullSafe(F.col("conv"))]).filter("cid > home").groupBy("cid").agg(F.collect_list("pos").alias("late"))
    each = chunks.join(late, "cid", "left").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("cid", "sig", "late", "low", "high", "different"))).alias("parts"))

    def fold(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bytesops.batches(source):
            for parts in b.column(0).to_pylist():
                sig, low, high, different = [], None, None, 0
                for part in parts:
                    letters = np.frombuffer(part["sig"].encode(), np.uint8).copy()
                    at = np.array(part["late"] or [], np.int64)
                    letters[at] = letters[at] - (letters[at] - 65) % 4 + FAULTS.index("d")
                    sig.append(letters.tobytes().decode())
                    if part["low"] is not None:
                        different += part["different"] - (part["low"] == high)
                        low, high = part["low"] if low is None else low, part["high"]
                gaps = 0 if low is None else high - low + 1 - different
                values = (parts[0]["cid"], [p["cid"] for p in parts], list(map(len, sig)), "".join(sig), gaps)
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], ["key", "cids", "counts", "sig", "gaps"])

    return each.select("parts").mapInArrow(fold, "key bigint, cids array<bigint>, counts array<int>, sig string, gaps bigint")


def _solved(signatures: DataFrame) -> DataFrame:
    """sig, rows and what follows from the signature: blank, duplicate, truncated, illegal, cost, audit, lead (a system turn stays first)."""

    def judge(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bytesops.batches(source):
            out = []
            for sig, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                code = np.frombuffer(sig.encode(), np.uint8) - 65
                role, fault = code // 4, np.bincount(code % 4, minlength=4)
                a, b_ = role[:-1], role[1:]  # su, ua and au follow each other
                legal = (b_ == 1) & ((a == 0) | (a == 2)) | (a == 1) & (b_ == 2)
                cost, audit = solve(sig)
                kept = next((k for k, e in enumerate(audit) if e != "D"), None)
                lead = kept is not None and audit[kept] == "K" and bool(role[kept] == 0)
                out.append((sig, n, int(fault[2]), int(fault[3]), int(fault[1]), int((~legal).sum()), cost, audit, lead))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.string(), *[pa.int64()] * 6, pa.string(), pa.bool_()], strict=True)], names)

    names = ["sig", "rows", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "lead"]
    distinct = signatures.groupBy("sig").agg(F.count("*").alias("rows"))
    return distinct.mapInArrow(judge, "sig string, rows bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, lead boolean")


def _with_audits(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """rows with what was solved for their signatures. The solved side is broadcast if its bytes allow; else hot signatures are dealt to parts."""
    size = solved.agg(F.sum(F.length("sig") + F.length("audit") + 64).alias("bytes"), F.sum("rows").alias("rows")).first()
    if (size["bytes"] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(solved.drop("rows")), "sig")
    is_hot = F.col("rows") > HOT * size["rows"]
    hot = F.broadcast(solved.filter(is_hot).select(F.xxhash64("sig").alias("h")).distinct())  # 1 / HOT hashes at most
    dealt = rows.withColumn("h", F.xxhash64("sig")).join(hot.withColumn("hot", F.lit(True)), "h", "left")
    dealt = dealt.withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("cid"), F.lit(PARTS))).otherwise(0)).drop("h", "hot")
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("hot"), PARTS - 1).otherwise(0).cast("bigint")))
    many = solved.withColumn("h", F.xxhash64("sig")).join(hot.withColumn("hot", F.lit(True)), "h", "left").withColumn("part", copies).drop("h", "hot", "rows")
    return dealt.join(many, ["sig", "part"]).drop("part")


def _slices(whole: DataFrame) -> DataFrame:
    """cid, key, edits, before (turns of the result before them), lead: the audits of conversations, cut at their chunks."""

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bytesops.batches(source):
            for key, cids, counts, audit, lead in zip(*(c.to_pylist() for c in b.columns), strict=True):
                code = np.frombuffer(audit.encode(), np.uint8)
                turn = np.flatnonzero(code != ord("I")) + 1
                ends = turn[np.cumsum(counts) - 1].tolist()
                ends[-1] = len(code)
                before = np.concatenate([[0], np.cumsum(code != ord("D"))])
                starts = [0, *ends[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array([key] * len(cids), pa.int64()), pa.array([audit[x:y] for x, y in zip(starts, ends, strict=True)], pa.string()), pa.array(before[starts], pa.int64()), pa.array([lead] * len(cids))], ["cid", "key", "edits", "before", "lead"])

    return whole.select("key", "cids", "counts", "audit", "lead").mapInArrow(cut, "cid bigint, key bigint, edits string, before bigint, lead boolean")


def replay(roles: list[str], texts: list[str], edits: str, before: int = 0, lead: bool = False) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of each turn of the result."""
    k = 0
    for e in edits:
        if e != "D":
            new = "user" if (before - lead) % 2 == 0 else "assistant"
            yield (roles[k] if e == "K" else new), ("" if e == "I" else texts[k]), e
            before += 1
        k += e != "I"


def _plan(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with their edits (cid, key, conv_id, open, roles, texts, edits, before, lead), and the findings of open conversations by key."""
    chunks = graph.table(_chunks(rows))
    closed, open_ = chunks.filter("NOT open"), chunks.filter("open")
    whole = graph.table(_whole(open_))
    solved = graph.cut(_solved(closed.select("sig").unionByName(whole.select("sig"))))
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("different"))
    own = _with_audits(closed.withColumn("gaps", gaps).drop("low", "high", "different", "digests"), solved)
    found = _with_audits(whole.withColumn("cid", F.col("key")), solved).drop("cid")
    parts = open_.select("cid", "conv_id", "open", "roles", "texts").join(_slices(found), "cid")
    own = own.withColumns({"key": F.col("cid"), "edits": F.col("audit"), "before": F.lit(0).cast("bigint")})
    return own.unionByName(parts, allowMissingColumns=True), found


FINDINGS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def report(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation of rows.

    rows: conv_id (any type that has an order), turn (whole numbers), role, text; other columns are ignored. Nulls of
    role and text count as one space; rows without conv_id are one conversation. Turns are taken in order, nulls first,
    and rows of the same turn in order of a digest of role and text, so that repeats are adjacent. The first fault of a
    turn counts: blank, a repeat of an earlier turn's role and text, cut off (no .!? at its end). Conversations may be
    of any length, their texts too; a letter and an edit for each turn of one conversation are held by one task. No rows
    give no rows.
    """
    chunks, found = _plan(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def digest(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bytesops.batches(source):
            out = []
            for open_, *given in zip(*(b.column(c).to_pylist() for c in ("open", "roles", "texts", "edits", "before", "lead")), strict=True):
                text = "\n".join(f"{role}:{text}" for role, text, _ in replay(*given)).encode()
                out.append((text, None) if open_ else (None, hashlib.sha256(text).hexdigest()))
            arrays = [b.column(c) for c in ("conv_id", "key", "cid", *FINDINGS)] + [pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "key", "cid", *FINDINGS, "piece", "repaired_sha256"])

    def gather(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, empty = None, None, True
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([sha.hexdigest()])], ["key", "repaired_sha256"])
        for b in bytesops.batches(source):
            for k, piece in zip(b.column("key").to_pylist(), b.column("piece").to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        yield row()
                    key, sha, empty = k, hashlib.sha256(), True
                if piece:
                    sha.update(piece if empty else b"\n" + piece)
                    empty = False
        if key is not None:
            yield row()

    numbers = ", ".join(f"{c} {'string' if c == 'audit' else 'bigint'}" for c in FINDINGS)
    columns = ["conv_id", "key", "cid", "open", "roles", "texts", "edits", "before", "lead", *FINDINGS]
    done = graph.table(chunks.select(*columns).mapInArrow(digest, f"conv_id {kind}, key bigint, cid bigint, {numbers}, piece binary, repaired_sha256 string"))
    shown = ["conv_id", *FINDINGS, "repaired_sha256"]
    pieces = done.filter("piece IS NOT NULL")
    shas = pieces.select("key", "cid", "piece").repartition("key").sortWithinPartitions("key", "cid").mapInArrow(gather, "key bigint, repaired_sha256 string")
    names = pieces.filter("cid = key").select("key", "conv_id")
    return done.filter("piece IS NULL").select(*shown).unionByName(found.join(shas, "key").join(names, "key").select(*shown))


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), role, text, edit (K, R or I) of the turns as they are after the repair; rows as for report."""
    chunks, _ = _plan(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def play(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bytesops.batches(source):
            for conv, *given in zip(*(b.column(c).to_pylist() for c in ("conv_id", "roles", "texts", "edits", "before", "lead")), strict=True):
                if out := list(replay(*given)):
                    n = len(out)
                    arrays = [pa.array([conv] * n, b.column("conv_id").type), pa.array(range(given[3], given[3] + n), pa.int64())] + [pa.array(c, pa.string()) for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "pos", "role", "text", "edit"])

    return chunks.select("conv_id", "roles", "texts", "edits", "before", "lead").mapInArrow(play, f"conv_id {kind}, pos bigint, role string, text string, edit string")


def with_all(found: DataFrame, conversations: DataFrame) -> DataFrame:
    """found with a row of zeros, no edits and the digest of nothing for conversations that have none."""
    ids = conversations.select(F.col("conv_id").alias("conv")).distinct()
    all_ = ids.join(found, ids["conv"].eqNullSafe(found["conv_id"]), "left")
    fill = lambda c: F.coalesce(c, F.lit("") if c == "audit" else F.lit(0).cast("bigint")).alias(c)
    return all_.select(F.col("conv").alias("conv_id"), *[fill(c) for c in FINDINGS], F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _sql_way(key: Column | str, cost: str, edit: str) -> str:
    return f"CASE WHEN {key} = '~' THEN '~' ELSE lpad(CAST(CAST(left({key}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({key}, 10) || '{edit}' END"


def _sql() -> str:
    """Ways are texts of a cost of nine digits and the edits, so that the least text is the best way; '~' is no way."""
    ins = lambda k: _sql_way(k, "2", "I")
    spread = f"lambda s: [s[1], s[2], least(s[3], {ins('s[1]')}, {ins('s[2]')}, {ins('s[4]')}), s[4]]"
    spread2 = f"lambda s: [s[1], s[2], s[3], least(s[4], {ins('s[3]')})]"
    closed = lambda a: f"list_transform(list_transform([{a}], {spread}), {spread2})"
    dele = lambda k: _sql_way(k, "3", "D")
    late = "CASE WHEN x[2] = 't' THEN 1 ELSE 0 END"
    keep = lambda k: _sql_way(k, f"({late})", "K")
    name = lambda k: _sql_way(k, f"(2 + {late})", "R")
    stay = lambda role, k: f"CASE WHEN x[2] IN ('b', 'd') THEN '~' WHEN x[1] = '{role}' THEN {keep(k)} ELSE {name(k)} END"
    system = f"CASE WHEN x[2] IN ('b', 'd') OR x[1] <> 's' THEN '~' ELSE {keep('c[1]')} END"
    step = f"lambda c: [{dele('c[1]')}, least({dele('c[2]')}, {system}), least({dele('c[3]')}, {stay('u', 'c[1]')}, {stay('u', 'c[2]')}, {stay('u', 'c[4]')}), least({dele('c[4]')}, {stay('a', 'c[3]')})]"
    bits = "list_reduce([v, 0, 0, 0, 0, 0, 0, 0, 0], lambda q, _: CASE WHEN q & 1 = 1 THEN xor(q >> 1, 3988292384) ELSE q >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(ch)::BIGINT FOR ch IN string_split(k, '')]), lambda c, b: list_transform([xor(c, b)], lambda v: {bits})[1]), 4294967295)"
    return rf"""
WITH keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
summed AS (SELECT *, {crc} % 20 AS m FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role, CASE m WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN m = 3 THEN 2 ELSE 1 END)) AS copy
  FROM summed WHERE m <> 0
), ordered AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role)) || ':' || role || text), copy) AS i FROM damaged
), judged AS (
  SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS r,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'd' WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'k' ELSE 't' END AS f,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p
  FROM ordered
), conv AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
         count(*) FILTER (i > 1 AND p || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
         list_reduce(list_prepend(['000000000', '~', '~', '~'], list([r, f] ORDER BY i)), lambda acc, x: list_transform({closed('acc')}, {step})[1]) AS ways
  FROM judged GROUP BY conv_id
), best AS (SELECT *, list_transform({closed('ways')}, lambda e: least(e[1], e[4]))[1] AS best FROM conv),
solved AS (SELECT * EXCLUDE (ways, best), CAST(left(best, 9) AS BIGINT) AS cost, substr(best, 10) AS audit FROM best),
edit AS (SELECT conv_id, unnest(string_split(audit, '')) AS e, unnest(range(1, length(audit) + 1)) AS j FROM solved WHERE audit <> ''),
placed AS (SELECT *, sum((e <> 'I')::INT) OVER w AS i, sum((e <> 'D')::INT) OVER w AS o FROM edit WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
made AS (SELECT placed.conv_id, j, e, o, t.role, CASE WHEN e = 'I' THEN '' ELSE t.text END AS text, max((o = 1 AND e = 'K' AND r = 's')::INT) OVER (PARTITION BY placed.conv_id) AS lead
  FROM placed LEFT JOIN judged t ON t.conv_id IS NOT DISTINCT FROM placed.conv_id AND t.i = placed.i WHERE e <> 'D'),
text AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS text FROM made GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN text t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""


SQL = _sql()
