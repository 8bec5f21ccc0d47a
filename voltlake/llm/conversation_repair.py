"""Conversation structure repair: an automaton of role/fault signatures, shared from the end, gives the cheapest edits.

A conversation is legal when its roles' initials are ``(s?(ua)+)?``. Rows may be kept, reroled, deleted or inserted; the cheapest edits are
found by cost-to-go, not conversation by conversation but once for each distinct end of a signature:

1. **Signatures.** Rows stream in order through tasks that hold no conversation, and each leaves one letter: its role class (s, u, a, other) and
   whether it is truncated, or that it must go (blank, duplicate). First occurrences are marked beforehand by a partial aggregation of digests, so
   duplicates need no memory of what was seen.
2. **Automaton.** Distinct signatures are sorted by their letters read from the end, in ranges. In that order each signature shares with the one
   before it exactly the nodes (distinct ends) that were built already: a node is the letter and the node behind it, and is built once, with
   cost-to-go and first edit for each of the grammar's four states; the edits of the best audit's rest are those of the node behind. A task holds
   the nodes of one signature. Costs count from a node's least, so nodes that differ by a constant share one table entry.
3. **Repair.** Audits go back to their conversations in front of the rows, and the repaired rows are hashed as they stream by.

Edits cost 0 (Keep), 3 (Rerole to user or assistant), 4 (Delete), 3 (Insert an empty user or assistant), and a truncated row that isn't deleted 3
more. Among the cheapest, the ASCII-least string of initials is taken: two edits of one state never share an initial, so the first decides.

Null roles and texts are one space. Rows of a conversation come by turn, nulls first; ties by role, then by their text's SHA-256. Rows with a null
conversation id are one conversation. A conversation may hold any number of rows: its rows are one task's (a hash is sequential), one at a time, its
signature and audit take a byte a row. Repeated rows are duplicates; an empty table gives an empty result; further columns take no part.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import CRC_TABLE_SQL, crc_sql, discard, staged, table

#: What a blank text consists of, and the marks that end a sentence.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Letters of a signature: s, u, a, o (other) as they are, capitals when truncated, - for rows that must go.
GONE = "-"
#: Grammar states: nothing yet, after s, after u, after a; and what a user or assistant row does in them.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
DUE = ("user", "user", "assistant", "user")
ENDING = (0, 1 << 40, 1 << 40, 0)  # cost-to-go behind the last row


@functools.cache
def step(letter: str, behind: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[str, ...], int]:
    """Of a node: cost-to-go by state (from its least), the edits up to and with this row by state, and the least. behind: the node's behind it."""
    base: list[tuple[int, str]] = []
    kind, late = letter.lower(), TRUNCATED * letter.isupper()
    for state in range(4):
        found = [(DELETE + behind[state], "D")]
        if letter != GONE:
            if kind == "s" and state == START:
                found.append((KEEP + late + behind[AFTER_S], "K"))
            if kind == DUE[state][0]:
                found.append((KEEP + late + behind[NEXT[state]], "K"))
            found.append((REROLE + late + behind[NEXT[state]], "R"))
        base.append(min(found))
    return settled(base)


def settled(base: list[tuple[int, str]]) -> tuple[tuple[int, ...], tuple[str, ...], int]:
    """The states' least costs when rows may also be inserted first; a run of two inserts comes back to a state of the same future."""
    best = list(base)
    for _ in range(3):
        best = [min(best[s], (INSERT + best[NEXT[s]][0], "I" + best[NEXT[s]][1])) for s in range(4)]
    least = min(c for c, _ in best)
    return tuple(c - least for c, _ in best), tuple(e for _, e in best), least


def walk(state: int, edits: str, kind: str) -> int:
    """The grammar state after a node's edits, of which the last is the row's own."""
    for e in edits:
        if e != "D":
            state = AFTER_S if e == "K" and kind == "s" else NEXT[state]
    return state


class Automaton:
    """Nodes of one signature at a time, by their distance from the end; what the next one shares with it is kept."""

    def __init__(self):
        self.letters = ""  # of the nodes, from the end
        self.nodes: list[tuple[tuple[int, ...], tuple[str, ...], int]] = [settled([(c, "") for c in ENDING])]
        self.built = 0

    def audit(self, signature: str) -> tuple[int, str]:
        """Cost and audit of a signature; signatures come sorted by their reverse."""
        back = signature[::-1]
        shared = 0
        top = min(len(back), len(self.letters))
        while shared < top and back[shared] == self.letters[shared]:
            shared += 1
        del self.nodes[shared + 1 :]
        for letter in back[shared:]:
            self.nodes.append(step(letter, self.nodes[-1][0]))
        self.built += len(back) - shared
        self.letters = back
        state, out = START, []
        for k in range(len(self.nodes) - 1, -1, -1):
            edits = self.nodes[k][1][state]
            out.append(edits)
            state = walk(state, edits, back[k - 1].lower() if k else "")
        return self.nodes[-1][0][START] + sum(n[2] for n in self.nodes), "".join(out)


SIGNED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"


def _signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its rows in order; a row of kind 0 is the mark of a first occurrence in front of its own."""
    out: list[tuple] = []
    now, marked, row = None, None, None

    def fresh(conv):
        return {"conv": conv, "low": None, "high": None, "turns": 0, "last": "", "letters": bytearray(), "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "any": False}

    def close(s):
        gaps = s["high"] - s["low"] + 1 - s["turns"] if s["turns"] else 0
        out.append((s["conv"], gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], s["letters"].decode()))

    def pack():
        names = [x.split()[0] for x in SIGNED.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.string()]
        done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        out.clear()
        return done

    for batch in batches:
        for conv, turn, role, digest, kind, blank, ended in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "digest", "kind", "blank", "ended")), strict=True):
            if now is None or now["conv"] != conv:
                if now is not None:
                    close(now)
                now, marked = fresh(conv), None
            if kind == 0:
                marked = (turn, role, digest)
                continue
            if kind == 2:  # stands for a dropped row
                continue
            row = (turn, role, digest)
            if turn is not None:
                if now["high"] != turn:
                    now["turns"] += 1
                now["low"], now["high"] = turn if now["low"] is None else now["low"], turn
            initial = role[:1]
            if now["any"] and now["last"] + initial not in ("su", "ua", "au"):
                now["illegal"] += 1
            now["any"], now["last"] = True, initial
            if blank:
                now["blank"] += 1
                letter = GONE
            elif marked != row:
                now["duplicate"] += 1
                letter = GONE
            else:
                letter = initial if initial in ("s", "u", "a") else "o"
                if not ended:
                    now["truncated"] += 1
                    letter = letter.upper()
            marked = None
            now["letters"] += letter.encode()
        if len(out) > 1000:
            yield pack()
    if now is not None:
        close(now)
    if out:
        yield pack()


def _auditor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for batch in batches:
        signatures = batch["signature"].to_pylist()
        made = [automaton.audit(s) for s in signatures]
        yield pa.RecordBatch.from_arrays([pa.array(signatures, pa.string()), pa.array([c for c, _ in made], pa.int64()), pa.array([a for _, a in made], pa.string())], names=["signature", "cost", "audit"])


def _repairer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of the repaired rows; a conversation's audit comes in front of its rows (kind 0)."""
    out: list[tuple] = []
    conv, audit, at, state, digest, first = None, None, 0, START, None, True

    def put(role: str, text: str):
        nonlocal first
        digest.update((role + ":" + text if first else "\n" + role + ":" + text).encode("utf-8", "surrogatepass"))
        first = False

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            put(DUE[state], "")
            state, at = NEXT[state], at + 1

    def close():
        inserts()
        out.append((conv, digest.hexdigest()))

    def pack():
        done = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["conv_id", "repaired_sha256"])
        out.clear()
        return done

    for batch in batches:
        for c, kind, role, text, given in zip(*(batch[x].to_pylist() for x in ("conv_id", "kind", "role", "text", "audit")), strict=True):
            if kind == 0:
                if audit is not None:
                    close()
                conv, audit, at, state, digest, first = c, given, 0, START, hashlib.sha256(), True
                continue
            inserts()
            edit, at = audit[at], at + 1
            if edit == "K":
                put(role, text)
                state = AFTER_S if role[:1] == "s" else NEXT[state]
            elif edit == "R":
                put(DUE[state], text)
                state = NEXT[state]
        if len(out) > 1000:
            yield pack()
    if audit is not None:
        close()
    if out:
        yield pack()


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of ``rows``.

    rows: conv_id, turn, role, text and ``here`` (false: the conversation is to be in the result though this row is gone).
    """
    given = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "here",
    )
    digest = F.when(F.col("here"), F.unhex(F.sha2("text", 256))).alias("digest")
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    ended = F.substring(bare, -1, 1).isin(*ENDS).alias("ended")
    light = given.select("conv_id", "turn", "role", digest, F.when(F.col("here"), 1).otherwise(2).alias("kind"), (F.length(bare) == 0).alias("blank"), ended)
    earliest = F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("f")
    marks = light.filter("kind = 1").groupBy("conv_id", "role", "digest").agg(earliest)
    marks = marks.select("conv_id", F.col("f.turn").alias("turn"), "role", "digest", F.lit(0).alias("kind"), F.lit(False).alias("blank"), F.lit(False).alias("ended"))
    order = ["conv_id", "turn", "role", "digest", "kind"]
    signed = light.unionByName(marks).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_signer, SIGNED)
    signed = staged(signed, "signatures")
    distinct = staged(signed.select("signature").distinct().withColumn("back", F.reverse("signature")), "distinct")
    ranges = max(1, distinct.count() // 50_000)
    audits = staged(distinct.repartitionByRange(ranges, "back").sortWithinPartitions("back").select("signature").mapInArrow(_auditor, "signature string, cost long, audit string"), "audits")
    told = staged(signed.join(audits, "signature").drop("signature"), "audited")
    discard(signed, distinct, audits)
    ahead = told.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit("").alias("text"), "audit")
    heavy = given.filter("here").select("conv_id", F.lit(1).alias("kind"), "turn", "role", digest, "text", F.lit(None).cast("string").alias("audit"))
    streamed = ahead.unionByName(heavy).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest").drop("digest", "turn")
    hashes = staged(streamed.mapInArrow(_repairer, "conv_id long, repaired_sha256 string"), "repaired")
    return told.join(hashes, told["conv_id"].eqNullSafe(hashes["conv_id"])).drop(hashes["conv_id"])


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of ``repair`` after damage by a checksum of each row's id and turn."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    m = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    d = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), m.alias("m"))
    text = F.when(F.col("m") == 1, "").when(F.col("m") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("m") == 4, "user").otherwise(F.col("role"))
    d = d.withColumn("copy", F.explode(F.when(F.col("m") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("m") != 0).alias("here"))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


QUERIES = {"op12_conversation_repair": op12_conversation_repair}


def _plus(value: str, cost: str, edit: str) -> str:
    """SQL: a padded cost in front of its audit, with an edit put before."""
    return f"lpad(CAST(CAST(left({value}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || '{edit}' || substr({value}, 13)"


def _base(state: str, after: str, due: str) -> str:
    keep = [f"CASE WHEN f <> 'x' AND i = '{due}' THEN {_plus(after, 'late', 'K')} END"]
    if state == "v0":
        keep.append(f"CASE WHEN f <> 'x' AND i = 's' THEN {_plus('vs', 'late', 'K')} END")
    reroled = "CASE WHEN f <> 'x' THEN " + _plus(after, "late + 3", "R") + " END"
    return f"least({_plus(state, '4', 'D')}, {reroled}, {', '.join(keep)})"


ORACLE = {
    "op12_conversation_repair": rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
coded AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS m FROM conversations CROSS JOIN crc_of),
d AS (SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN m = 1 THEN '' WHEN m = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN m = 3 THEN [0, 1] ELSE [0] END) AS copy FROM coded WHERE m <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM d),
w AS MATERIALIZED (SELECT conv_id, turn, role, text, pos, left(role, 1) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    CASE WHEN regexp_matches(text, '^[ \x09-\x0D]*$') THEN 'x' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'x'
      WHEN regexp_matches(text, '[.!?][ \x09-\x0D]*$') THEN '' ELSE 't' END AS f,
    regexp_matches(text, '^[ \x09-\x0D]*$') AS blank, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS p FROM o),
back AS (SELECT conv_id, n AS place, '000000000000' AS v0, '000000000006II' AS vs, '000000000003I' AS vu, '000000000000' AS va FROM w WHERE pos = n
  UNION ALL
  SELECT conv_id, place, least(b0, {_plus('lu', '3', 'I')}), least(bs, {_plus('lu', '3', 'I')}), lu, least(ba, {_plus('bu', '3', 'I')})
  FROM (SELECT *, least(bu, {_plus('ba', '3', 'I')}) AS lu FROM (
    SELECT b.conv_id, b.place - 1 AS place, {_base('v0', 'vu', 'u')} AS b0, {_base('vs', 'vu', 'u')} AS bs, {_base('vu', 'va', 'a')} AS bu, {_base('va', 'vu', 'u')} AS ba
    FROM (SELECT back.*, w.i, w.f, CASE WHEN w.f = 't' THEN 3 ELSE 0 END AS late FROM back JOIN w ON w.conv_id IS NOT DISTINCT FROM back.conv_id AND w.pos = back.place) b))),
best AS (SELECT conv_id, CAST(left(v0, 12) AS BIGINT) AS cost, substr(v0, 13) AS audit FROM back WHERE place = 0),
forth AS (SELECT conv_id, audit, 1 AS k, 0 AS rows, '0' AS s, CAST([] AS VARCHAR[]) AS lines FROM best
  UNION ALL
  SELECT f.conv_id, f.audit, f.k + 1, f.rows + CASE WHEN e = 'I' THEN 0 ELSE 1 END,
    CASE WHEN e = 'D' THEN s WHEN e = 'K' AND i = 's' THEN 's' WHEN s = 'u' THEN 'a' ELSE 'u' END,
    CASE WHEN e = 'D' THEN lines WHEN e = 'K' THEN list_append(lines, role || ':' || text)
      ELSE list_append(lines, CASE WHEN s = 'u' THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END) END
  FROM (SELECT *, substr(audit, k, 1) AS e FROM forth WHERE k <= length(audit)) f LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.pos = f.rows + 1),
ended AS (SELECT conv_id, sha256(array_to_string(lines, chr(10))) AS h FROM forth WHERE k = length(audit) + 1),
counts AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE f = 'x' AND NOT blank) AS duplicate, count(*) FILTER (WHERE f = 't') AS truncated,
    count(*) FILTER (WHERE pos > 1 AND p || i NOT IN ('su', 'ua', 'au')) AS illegal FROM w GROUP BY conv_id)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
  coalesce(c.illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, coalesce(e.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON a.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN ended e ON a.conv_id IS NOT DISTINCT FROM e.conv_id"""
}
