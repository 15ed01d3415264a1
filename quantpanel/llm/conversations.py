"""Conversation structure repair: the cheapest edits that make a conversation an optional system turn and user/assistant pairs.

Rows stand by turn (null first; ties by a digest of role and text). A row's fault is the first of: blank (nothing but white
space), duplicate (role and text seen earlier), truncated (ends in none of `.!?`). Keeping a row costs 0, another role (user or
assistant) 1, deleting 2, inserting an empty user or assistant row 5, a truncated row that stays 5 more; blank and duplicate
rows must go. What is left reads `(s?(ua)+)?` by the initials of its roles. Of the cheapest edits the ASCII-least initials count.

1. Rows become (conversation, index, code) without their text; indexes come from ranges of (conversation, turn), so a
   conversation that holds most rows spans many tasks. A code is the role's class and the fault.
2. A conversation of n rows is cut into blocks of about sqrt(n) rows. Costs of states flow backward: a block is a min-plus
   matrix, and a conversation's matrices give the vector of costs at each of its checkpoints, the ends of its blocks.
3. Each block is computed again from its checkpoint, by itself and again with checkpoints at every square root of its length,
   and walked forward along tight edits, the ASCII-least first: from state 0 if it is the first block, else from each state.
4. Walks and texts meet, sorted by conversation: a task takes the walk of each block that starts where the one before it
   ended, applies the edits to the rows as they pass by and digests the repaired text. Texts are shuffled this once.

A conversation's digest can't be split, so its texts pass through one task as a stream; that task holds its audit, a letter a
row, and no text.

Defined cases: null role or text counts as one space, a null conv_id is a conversation of its own; rows of one turn are
ordered by a digest of role and text; equal rows are duplicates of each other; an empty table gives an empty result; very long
texts are digested whole; extra columns don't matter; a conversation without rows has no result of `repair`, and zeros here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantpanel.llm.common import SPACES, crc32_sql, cut, numbered, table

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
CLASSES, FAULTS = "suax", ("none", "blank", "duplicate", "truncated")
#: A row's code: the letter at place 4 * class + fault.
CODES = "abcdefghijklmnop"
#: States: nothing yet, after the system row, after a user row, after an assistant row. What each takes next, and where to.
WANTS, NEXT = "uuau", (2, 2, 3, 2)
ROLES = {"u": "user", "a": "assistant"}
#: Costs behind the last row; from state 1 a pair has to be inserted.
END = (0, 10, 5, 0)
LEAST_BLOCK = 64
WALKS = "array<struct<exit:int,cost:bigint,edits:string>>"
Vector = tuple[int, int, int, int]


# --- the cost of states --------------------------------------------------------------------------------------------------
def before(code: str, v: Vector) -> Vector:
    """Costs of the states in front of a row and of what may be inserted there, from those behind it."""
    cls, fault = divmod(ord(code) - 97, 4)
    w = [DELETE + c for c in v]
    if fault in (0, 3):
        more = CUT_OFF if fault else 0
        for s in range(4):
            w[s] = min(w[s], more + v[NEXT[s]] + (KEEP if CLASSES[cls] == WANTS[s] else REROLE))
        if cls == 0:
            w[0] = min(w[0], more + v[1] + KEEP)
    u = min(w[2], INSERT + w[3])
    return (min(w[0], INSERT + u), min(w[1], INSERT + u), u, min(w[3], INSERT + w[2]))


def matrix(codes: str) -> list[int]:
    """Least costs from each state in front of a block to each behind it, row by row."""
    far = 1 << 50
    columns = []
    for t in range(4):
        v: Vector = tuple(0 if s == t else far for s in range(4))  # type: ignore[assignment]
        for code in reversed(codes):
            v = before(code, v)
        columns.append(v)
    return [columns[t][s] for s in range(4) for t in range(4)]


def through(m: list[int], v: Vector) -> Vector:
    return tuple(min(m[4 * s + t] + v[t] for t in range(4)) for s in range(4))  # type: ignore[return-value]


def walk(codes: str, behind: Vector, states: tuple[int, ...], last: bool) -> list[tuple[int, int, str]]:
    """(state behind the block, cost from its front, edits) for each of `states` in front of it.

    Vectors are kept at every sqrt(len(codes))-th row; the rows between are computed again from there while walking.
    """
    step, v = max(1, isqrt(len(codes))), behind
    kept = {len(codes): behind}
    for i in range(len(codes) - 1, -1, -1):
        v = before(codes[i], v)
        if i % step == 0:
            kept[i] = v
    at, edits = list(states), [[] for _ in states]
    for start in range(0, len(codes), step):
        end = min(start + step, len(codes))
        costs = [kept[end]]
        for i in range(end - 1, start - 1, -1):
            costs.append(before(codes[i], costs[-1]))
        costs.reverse()
        for k, out in enumerate(edits):
            s = at[k]
            for i in range(start, end):
                here, after = costs[i - start], costs[i - start + 1]
                cls, fault = divmod(ord(codes[i]) - 97, 4)
                while DELETE + after[s] != here[s] and INSERT + here[NEXT[s]] == here[s]:
                    out.append("I")
                    s = NEXT[s]
                more = CUT_OFF if fault == 3 else 0
                if DELETE + after[s] == here[s]:
                    out.append("D")
                elif cls == 0 and s == 0 and more + after[1] == here[0]:
                    out.append("K")
                    s = 1
                elif CLASSES[cls] == WANTS[s] and more + after[NEXT[s]] == here[s]:
                    out.append("K")
                    s = NEXT[s]
                else:
                    out.append("R")
                    s = NEXT[s]
            at[k] = s
    first = kept[0]
    if last:
        for k, out in enumerate(edits):
            while END[at[k]]:
                out.append("I")
                at[k] = NEXT[at[k]]
    return [(at[k], first[states[k]], "".join(edits[k])) for k in range(len(states))]


# --- rows to codes -------------------------------------------------------------------------------------------------------
def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by the row's hash; a row that is repeated comes twice."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    hit = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", F.when(hit == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(hit == 0, F.array().cast("array<int>")).when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def keyed(rows: DataFrame) -> DataFrame:
    """conv (a key without nulls), turn, role, text, and print, by which equal rows are known and ties are ordered."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    conv = F.when(F.col("conv_id").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("conv_id").cast("string")))
    return rows.select(conv.alias("conv"), "turn", role.alias("role"), text.alias("text"), F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("print"))


def blocks(rows: DataFrame) -> DataFrame:
    """conv, block, blocks (of the conversation) and codes, a letter a row in order. `rows` are keyed."""
    tail = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    fault = F.when(tail == "", 1).when(tail.isin(".", "!", "?"), 0).otherwise(3)
    cls = F.instr(F.lit("sua"), F.left("role", F.lit(1)))
    cls = F.when((F.length("role") == 0) | (cls == 0), 3).otherwise(cls - 1)
    # Equal rows are interchangeable; a number of their own lets many of them span tasks. Written first, as ranges are found
    # on a sample and texts shouldn't be digested for that too.
    own = rows.select("conv", "turn", "print", cls.alias("cls"), fault.alias("fault")).withColumn("own", F.monotonically_increasing_id())
    codes = numbered(cut(own), ["conv"], ["turn", "print", "own"])
    first = codes.groupBy("conv", "print").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeated = F.col("first").isNotNull() & (F.col("idx") > F.col("first"))
    code = F.col("cls") * 4 + F.when(F.col("fault") == 1, 1).when(repeated, 2).otherwise(F.col("fault"))
    size = F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.sqrt("total"))).cast("long")
    marked = codes.join(first, ["conv", "print"], "left").select("conv", "idx", F.substring(F.lit(CODES), code + 1, F.lit(1)).alias("code"), size.alias("size"), "total")
    found = marked.groupBy("conv", F.expr("idx div size").alias("block")).agg(F.first(F.expr("(total - 1) div size + 1")).alias("blocks"), F.sort_array(F.collect_list(F.struct("idx", "code"))).alias("rows"))
    return found.select("conv", "block", "blocks", F.array_join(F.transform("rows", lambda r: r["code"]), "").alias("codes"))


# --- walks ---------------------------------------------------------------------------------------------------------------
def checkpoints(found: DataFrame) -> DataFrame:
    """The blocks of conversations that have several, with behind, the costs at their ends."""

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([matrix(c) for c in b.column("codes").to_pylist()], pa.list_(pa.int64()))], [*b.schema.names, "matrix"])

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, v = None, END
        for b in batches:
            out = []
            for c, m in zip(b.column("conv").to_pylist(), b.column("matrix").to_pylist()):
                v = END if c != conv else v
                out.append(v)
                conv, v = c, through(m, v)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("conv", "block", "blocks", "codes")), pa.array(out, pa.list_(pa.int64()))], ["conv", "block", "blocks", "codes", "behind"])

    kinds = "conv string, block long, blocks long, codes string"
    priced = found.where("blocks > 1").mapInArrow(matrices, f"{kinds}, matrix array<long>")
    return priced.repartition("conv").sortWithinPartitions("conv", F.desc("block")).mapInArrow(backward, f"{kinds}, behind array<long>").repartition("conv", "block")


def walked(found: DataFrame) -> DataFrame:
    """conv, block, codes, walks (one a state in front of the block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(20_000)(walk)  # most conversations are short and alike
        for b in batches:
            out = []
            for block, n, codes, behind in zip(*(b.column(c).to_pylist() for c in ("block", "blocks", "codes", "behind"))):
                ways = known if len(codes) <= LEAST_BLOCK else walk
                out.append([dict(zip(("exit", "cost", "edits"), w)) for w in ways(codes, tuple(behind), (0,) if block == 0 else (0, 1, 2, 3), block == n - 1)])
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("block"), b.column("codes"), pa.array(out, pa.list_(pa.struct([("exit", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])))], ["conv", "block", "codes", "walks"])

    found = cut(found)
    alone = found.where("blocks = 1").withColumn("behind", F.array(*(F.lit(x).cast("long") for x in END)))
    return alone.unionByName(checkpoints(found)).mapInArrow(run, f"conv string, block long, codes string, walks {WALKS}")


def lines(codes: str, edits: str) -> Iterator[tuple[str, str | None]]:
    """(edit, role that it gives or None) of a whole conversation's edits, in order."""
    s, row = 0, 0
    for e in edits:
        if e == "D":
            yield e, None
        elif e == "K" and codes[row] < "e":  # the system row
            yield e, None
            s = 1
        else:
            yield e, None if e == "K" else ROLES[WANTS[s]]
            s = NEXT[s]
        row += e != "I"


class Conversation:
    """One conversation as its walks and then its rows pass by."""

    def __init__(self, conv: str):
        self.conv, self.codes, self.edits, self.state, self.cost, self.todo = conv, [], [], 0, None, None

    def add_walk(self, codes: str, walks: list[dict]) -> None:
        way = walks[self.state if len(walks) > 1 else 0]
        self.codes.append(codes)
        self.edits.append(way["edits"])
        self.state, self.cost = way["exit"], way["cost"] if self.cost is None else self.cost

    def inserted_and(self, row: tuple[str, str] | None) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the rows to insert in front of `row`, and of the row if it stays; None: behind all rows."""
        if self.todo is None:
            self.codes, self.edits = "".join(self.codes), "".join(self.edits)
            self.todo = lines(self.codes, self.edits)
        for edit, role in self.todo:
            if edit == "I":
                yield edit, role, ""
                continue
            if edit != "D":
                yield edit, role or row[0], row[1]
            return

    def figures(self) -> dict:
        cls = "".join(CLASSES[(ord(c) - 97) // 4] for c in self.codes)
        fault = lambda k: sum(self.codes.count(CODES[4 * c + k]) for c in range(4))
        illegal = sum(p not in ("su", "ua", "au") for p in map("".join, zip(cls, cls[1:])))
        return {"conv": self.conv, "blank": fault(1), "duplicate": fault(2), "truncated": fault(3), "illegal": illegal, "cost": self.cost, "audit": self.edits}


def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Conversation, Iterator[tuple[str, str, str]], bool]]:
    """(conversation, repaired rows, is it over) for every row of the stream and once at the end of each conversation."""
    now = None
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("conv", "codes", "walks", "role", "text")]
        for conv, codes, walks, role, text in zip(*columns):
            if now is None or now.conv != conv:
                if now:
                    yield now, now.inserted_and(None), True
                now = Conversation(conv)
            if walks is not None:
                now.add_walk(codes, walks)
            else:
                yield now, now.inserted_and((role, text)), False
    if now:
        yield now, now.inserted_and(None), True


def stream(rows: DataFrame) -> DataFrame:
    """Walks and rows of each conversation in one task, walks first, rows in the order of their codes. `rows` are keyed."""
    ways = walked(blocks(rows)).withColumns({"turn": F.lit(None).cast("long"), "print": F.lit(None).cast("string"), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    texts = rows.withColumns({"block": F.lit(None).cast("long"), "codes": F.lit(None).cast("string"), "walks": F.lit(None).cast(WALKS)})
    both = ways.unionByName(texts.withColumn("turn", F.col("turn").cast("long")))
    return both.repartition("conv").sortWithinPartitions("conv", F.col("block").asc_nulls_last(), F.col("turn").asc_nulls_first(), "print").select("conv", "codes", "walks", "role", "text")


def repair(rows: DataFrame) -> DataFrame:
    """The repaired rows: conv_id as text (null: null), place (from 0), edit (K, R or I), role, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, size = [], 0, 0
        for now, kept, over in passing(batches):
            for edit, role, text in kept:
                out.append({"conv_id": now.conv[1:] if now.conv[0] == "1" else None, "place": place, "edit": edit, "role": role, "text": text})
                place, size = place + 1, size + len(text)
            place = 0 if over else place
            if len(out) >= 5_000 or size > 8_000_000:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    kinds = pa.schema([("conv_id", pa.string()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    return stream(keyed(rows)).mapInArrow(run, "conv_id string, place long, edit string, role string, text string")


def audit(rows: DataFrame) -> DataFrame:
    """conv, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation that has rows."""
    kinds = pa.schema([("conv", pa.string()), *((n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, digest, first = [], hashlib.sha256(), True
        for now, kept, over in passing(batches):
            for _, role, text in kept:
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                first = False
            if over:
                out.append(now.figures() | {"repaired_sha256": digest.hexdigest()})
                digest, first = hashlib.sha256(), True
                if len(out) >= 5_000:
                    yield pa.RecordBatch.from_pylist(out, kinds)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    return stream(keyed(rows)).mapInArrow(run, "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def structure(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conv_id of `conversations`: gaps between the turns of `rows`, and what `audit` says of them."""
    gaps = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps"))
    found = conversations.select("conv_id").distinct().alias("c").join(gaps.alias("g"), F.col("c.conv_id").eqNullSafe(F.col("g.conv_id")), "left")
    conv = F.when(F.col("c.conv_id").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("c.conv_id").cast("string")))
    found = found.select("c.conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), conv.alias("conv")).join(audit(rows), "conv", "left").drop("conv")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return found.select("conv_id", "gaps", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), *(F.coalesce(c, F.lit(v)).alias(c) for c, v in empty.items()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return structure(conversations, damage(conversations))


def before_sql(state: int) -> str:
    """Cost in front of a row without insertions, by the vector v behind it."""
    kept = f"extra + v[{NEXT[state] + 1}] + (cls <> '{WANTS[state]}')::INT"
    if state == 0:
        kept = f"least({kept}, CASE WHEN cls = 's' THEN extra + v[2] ELSE 1000000000000 END)"
    return f"CASE WHEN gone THEN {DELETE} + v[{state + 1}] ELSE least({DELETE} + v[{state + 1}], {kept}) END"


BLANKS = r"[\x20\x09-\x0D]"
SQL = rf"""
WITH RECURSIVE hits AS (SELECT *, {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS hit FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
    unnest(CASE hit WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM hits),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS i FROM damaged),
told AS (SELECT *, left(role, 1) AS cls, regexp_replace(text, '{BLANKS}+$', '') AS said, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS next_cls FROM placed),
faults AS (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM told),
coded AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN {CUT_OFF} ELSE 0 END AS extra FROM faults),
summed AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE next_cls IS NOT NULL AND cls || next_cls NOT IN ('su', 'ua', 'au')) AS illegal FROM coded GROUP BY conv_id),
costs AS (SELECT conv_id, n + 1 AS i, {list(END)}::BIGINT[] AS v FROM summed UNION ALL
  SELECT conv_id, i, [least(w[1], {INSERT} + w[3], {2 * INSERT} + w[4]), least(w[2], {INSERT} + w[3], {2 * INSERT} + w[4]), least(w[3], {INSERT} + w[4]), least(w[4], {INSERT} + w[3])] FROM (
    SELECT r.conv_id, r.i, [{", ".join(map(before_sql, range(4)))}] AS w FROM costs c JOIN coded r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = c.i - 1)),
steps AS (SELECT r.conv_id, r.i, r.role, r.text, r.cls, r.extra, c.v AS here, a.v AS after FROM costs c
  LEFT JOIN coded r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = c.i LEFT JOIN costs a ON a.conv_id IS NOT DISTINCT FROM c.conv_id AND a.i = c.i + 1 WHERE r.i IS NOT NULL
  UNION ALL SELECT conv_id, i, NULL, NULL, NULL, 0, v, NULL FROM costs JOIN summed USING (conv_id) WHERE i = n + 1),
forward AS (SELECT conv_id, 1::BIGINT AS i, 0 AS s, '' AS audit, []::VARCHAR[] AS said FROM summed UNION ALL
  SELECT conv_id, i + (op <> 'I')::INT, CASE WHEN op = 'D' THEN s WHEN op = 'K' AND cls = 's' THEN 1 ELSE nx END, audit || op,
    CASE op WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text) WHEN 'R' THEN list_append(said, CASE want WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text) ELSE list_append(said, CASE want WHEN 'u' THEN 'user' ELSE 'assistant' END || ':') END
  FROM (SELECT *, CASE WHEN {DELETE} + after[s + 1] = here[s + 1] THEN 'D' WHEN {INSERT} + here[nx + 1] = here[s + 1] THEN 'I'
      WHEN cls = 's' AND s = 0 AND extra + after[2] = here[1] OR cls = want AND extra + after[nx + 1] = here[s + 1] THEN 'K' WHEN cls IS NOT NULL THEN 'R' END AS op
    FROM (SELECT f.*, t.role, t.text, t.cls, t.extra, t.here, t.after, {list(NEXT)}[f.s + 1] AS nx, {list(WANTS)}[f.s + 1] AS want
      FROM forward f JOIN steps t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.i = f.i)) WHERE op IS NOT NULL),
ended AS (SELECT conv_id, max_by(audit, length(audit)) AS audit, max_by(said, length(audit)) AS said FROM forward GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(v[1], 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN summed s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN costs c ON c.conv_id IS NOT DISTINCT FROM o.conv_id AND c.i = 1 LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""
