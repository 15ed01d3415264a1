"""Merkle manifest of a dataset: a digest of every row, trees over them, and proofs that a row is part of the whole.

A leaf is the digest of a row's columns, each with its length. The rows of one value of `tree_col` are the leaves of a tree in
the order of their ids: while several nodes remain, every `ARITY` consecutive ones become the digest of their hex strings.
What remains is the tree's subroot; the subroots, in the order of their values (null first), are the leaves of one more tree.

1. One scan makes the leaves; texts are never shuffled. Leaves are numbered in their tree by ranges of (tree, id), so a tree
   that holds most rows spans many tasks.
2. Aligned blocks of `WIDTH` nodes are gathered, and a block keeps each of its levels as one string, the hex digests one
   behind the other. Parents are digests of substrings of fixed width. Blocks' last nodes are the nodes of the next stage,
   until a tree has one block; subroots go through the same stages.
3. From the root down each block learns the siblings above it, as pairs of strings: a node's siblings are the two substrings
   that flank it in its run. A block's children are unfolded from its strings, so no row is joined with its path.

Defined cases: a null column counts as `-`; an empty text as `0:`; a null id comes first, repeated ids follow in the order of
their leaves, equal rows are interchangeable; a tree of one leaf has that leaf as its subroot, and one tree's subroot is the
root; rows of a null id aren't tampered with; an empty table gives an empty result; very long texts are digested whole; extra
columns don't matter unless they are asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantpanel.llm.common import ascii_lower, crc32_sql, cut, numbered, table

ARITY, CLIMB, HEX = 8, 3, 64
#: Nodes of a block: it climbs CLIMB levels.
WIDTH = ARITY**CLIMB
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:binary,after:binary>>"


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def field(c: Column) -> Column:
    value = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def height(n: Column) -> Column:
    """Levels above n leaves: the least h with ARITY ** h >= n."""
    powers = F.array(*(F.lit(ARITY**k).cast("long") for k in range(21)))
    return F.size(F.filter(powers, lambda p: p < n))


def parents(level: Column) -> Column:
    """The next level's string; the last run may be shorter than the others."""
    run = ARITY * HEX
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / run).cast("int"))
    raw = level.cast("binary")  # substrings of binary values are cut without counting characters
    return F.array_join(F.transform(runs, lambda r: digest(F.substring(raw, r * run + 1, F.lit(run)))), "")


def siblings(levels: Column, climbed: Column, i: Column) -> Column:
    """For each level of a block, what stands before and behind the ancestor of its node i in that one's run."""
    out = []
    for j in range(CLIMB):
        raw, node = levels[j].cast("binary"), F.floor(i / ARITY**j).cast("int")
        first = node - node % ARITY
        out.append(F.struct(F.substring(raw, first * HEX + 1, (node - first) * HEX).alias("before"), F.substring(raw, (node + 1) * HEX + 1, (first + ARITY - node - 1) * HEX).alias("after")))
    return F.slice(F.array(*out), F.lit(1), climbed)


def stages(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of every stage: tree, block, levels, climbed, todo (levels still above), top (its last node) and items.

    `nodes` has tree, idx, node, todo and item; there are as many stages as WIDTH has powers below the largest tree.
    """
    out = []
    while True:
        items = F.sort_array(F.collect_list(F.struct("idx", "node", "item")))
        rows = nodes.groupBy("tree", F.expr(f"idx div {WIDTH}").alias("block")).agg(F.first("todo").alias("todo"), items.alias("items"))
        rows = rows.withColumn("climbed", F.least(F.lit(CLIMB), F.col("todo"))).withColumn("level0", F.array_join(F.transform("items", lambda x: x["node"]), ""))
        for j in range(CLIMB):
            rows = rows.withColumn(f"level{j + 1}", F.when(F.col("climbed") > j, parents(F.col(f"level{j}"))).otherwise(F.col(f"level{j}")))
        rows = rows.withColumn("todo", F.col("todo") - F.col("climbed")).withColumn("items", F.transform("items", lambda x: x["item"]))
        rows = cut(rows.select("tree", "block", F.array(*(f"level{j}" for j in range(CLIMB))).alias("levels"), "climbed", "todo", F.col(f"level{CLIMB}").alias("top"), "items"))
        out.append(rows)
        above = rows.where("todo > 0")
        if above.isEmpty():
            return out
        nodes = above.select("tree", F.col("block").alias("idx"), F.col("top").alias("node"), "todo", F.lit(None).cast("string").alias("item"))


def with_paths(blocks: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """The blocks of the first stage with path (siblings of their top, upwards), subroot and root.

    `above` has tree, path and root of every tree; without it each tree's own top is the root.
    """
    below = None
    for here in reversed(blocks):
        done = here.where("todo = 0").select("tree", "block", F.col("top").alias("subroot"))
        done = done.join(above, "tree") if above is not None else done.withColumn("path", F.array().cast(PATH)).withColumn("root", F.col("subroot"))
        paths = done if below is None else done.unionByName(below)
        found = here.join(paths, ["tree", "block"])
        each = F.sequence(F.lit(0), F.size("items") - 1)
        children = F.transform(each, lambda i: F.struct((F.col("block") * WIDTH + i).alias("block"), F.concat(siblings(F.col("levels"), F.col("climbed"), i), F.col("path")).alias("path")))
        below = found.select("tree", "subroot", "root", F.explode(children).alias("c")).select("tree", F.col("c.block").alias("block"), "subroot", "root", F.col("c.path").alias("path"))
    return found


def leaves(docs: DataFrame, id_col: str, tree_col: str, text_col: str, columns: tuple[str, ...]) -> DataFrame:
    """tree, doc_id, node, and the digest of the row after tampering where that changes it."""
    own = {c: docs[f"`{c}`"] for c in columns}
    whole = lambda cols: digest(F.concat(*(field(c) for c in cols)))
    doc_id, tree = docs[f"`{id_col}`"], docs[f"`{tree_col}`"].cast("string")
    struck = (F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0) & docs[f"`{text_col}`"].rlike("[A-Z]")
    tampered = F.when(struck, whole([ascii_lower(c) if n == text_col else c for n, c in own.items()]))
    # A value's order with null before all others, and no null as a key.
    return docs.select(F.when(tree.isNull(), "0").otherwise(F.concat(F.lit("1"), tree)).alias("tree"), doc_id.alias("doc_id"), whole(own.values()).alias("node"), tampered.alias("tampered"))


def manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", text_col: str = "text", columns: tuple[str, ...] = COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(blocks of leaves with their paths, trees), two tables from which every proof and root can be read.

    The first has tree, block, levels, climbed, items (doc_id and tampered digest), path, subroot, root; the second tree,
    subroot, path (from the subroot to the root) and root.
    """
    # Written first: ranges are found on a sample of them, and texts shouldn't be digested for that too.
    rows = numbered(cut(leaves(docs, id_col, tree_col, text_col, columns)), ["tree"], ["doc_id", "node"])
    low = stages(rows.select("tree", "idx", "node", height(F.col("total")).alias("todo"), F.struct("doc_id", "tampered").alias("item")))
    subroots = reduce(DataFrame.unionByName, (b.where("todo = 0").select(F.lit("").alias("tree"), F.col("tree").alias("item"), F.col("top").alias("node")) for b in low))
    subroots = numbered(subroots, ["tree"], ["item"])
    high = with_paths(stages(subroots.select("tree", "idx", "node", height(F.col("total")).alias("todo"), "item")), None)
    each = F.transform(F.sequence(F.lit(0), F.size("items") - 1), lambda i: F.struct(F.col("items")[i].alias("tree"), F.concat(siblings(F.col("levels"), F.col("climbed"), i), F.col("path")).alias("path")))
    trees = high.select("root", F.explode(each).alias("t")).select(F.col("t.tree").alias("tree"), F.col("t.path").alias("path"), "root")
    return with_paths(low, trees), trees


def proofs(blocks: DataFrame) -> DataFrame:
    """One row a leaf: doc_id, leaf, subroot, root, proof (siblings from the leaf to the root), tampered, folded_root."""

    def one(i: Column) -> Column:
        item, path = F.col("items")[i], F.concat(siblings(F.col("levels"), F.col("climbed"), i), F.col("path"))
        leaf = F.substring(F.col("levels")[0].cast("binary"), i * HEX + 1, F.lit(HEX)).cast("string")
        return F.struct(item["doc_id"].alias("doc_id"), leaf.alias("leaf"), path.alias("proof"), item["tampered"].alias("tampered"))

    rows = blocks.select("subroot", "root", F.explode(F.transform(F.sequence(F.lit(0), F.size("items") - 1), one)).alias("p")).select("p.*", "subroot", "root")
    fold = F.aggregate("proof", F.coalesce("tampered", "leaf"), lambda node, p: digest(F.concat(p["before"], node.cast("binary"), p["after"])))
    return rows.withColumn("folded_root", fold)


def merkle(docs: DataFrame, **names) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    joined = F.aggregate("proof", F.lit(b""), lambda acc, p: F.concat(acc, p["before"], p["after"]))
    return proofs(manifest(docs, **names)[0]).select("doc_id", "leaf", "subroot", "root", digest(joined).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle(table(spark, sf_dir, "documents"))


def leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


SQL = f"""
WITH RECURSIVE rows_ AS (SELECT *, {leaf_sql("text")} AS leaf,
  {leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low_leaf,
  {crc32_sql("doc_id::VARCHAR")} % 3 = 0 AS struck, coalesce('1' || lang, '0') AS tree FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM rows_),
low AS (SELECT tree, 0 AS lvl, i, n, leaf AS node FROM leaves UNION ALL
  SELECT tree, lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY tree, lvl, i // 8, n),
subroots AS (SELECT tree, lvl, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS lvl, i, n, subroot AS node FROM subroots UNION ALL
  SELECT lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY lvl, i // 8, n),
steps AS (  -- every node with what stands before and behind it in its run
  SELECT 'low' AS part, tree, lvl, i, coalesce(string_agg(node, '') OVER before, '') AS b, coalesce(string_agg(node, '') OVER behind, '') AS a FROM low WHERE n > 1
  WINDOW before AS (PARTITION BY tree, lvl, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), behind AS (PARTITION BY tree, lvl, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
  UNION ALL
  SELECT 'high', '', lvl, i, coalesce(string_agg(node, '') OVER before, ''), coalesce(string_agg(node, '') OVER behind, '') FROM high WHERE n > 1
  WINDOW before AS (PARTITION BY lvl, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), behind AS (PARTITION BY lvl, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
paths AS (SELECT tree, i AS leaf_i, list(struct_pack(b, a) ORDER BY lvl) AS path FROM
    (SELECT l.tree, l.i, s.lvl, s.b, s.a FROM leaves l JOIN steps s ON s.part = 'low' AND s.tree = l.tree AND s.i = l.i // (8 ** s.lvl)::BIGINT) GROUP BY tree, i),
tops AS (SELECT r.tree, list(struct_pack(s.b, s.a) ORDER BY s.lvl) AS path FROM subroots r JOIN steps s ON s.part = 'high' AND s.i = r.i // (8 ** s.lvl)::BIGINT GROUP BY r.tree),
whole AS (SELECT l.doc_id, l.leaf, r.subroot, (SELECT node FROM high WHERE n = 1) AS root, CASE WHEN struck THEN low_leaf ELSE l.leaf END AS start,
    list_concat(coalesce(p.path, []), coalesce(t.path, [])) AS path
  FROM leaves l JOIN subroots r USING (tree) LEFT JOIN paths p ON p.tree = l.tree AND p.leaf_i = l.i LEFT JOIN tops t ON t.tree = l.tree),
folded AS (SELECT *, start AS h, 0 AS k FROM whole UNION ALL SELECT doc_id, leaf, subroot, root, start, path, sha256(path[k + 1].b || h || path[k + 1].a), k + 1 FROM folded WHERE k < len(path))
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_concat([''], list_transform(path, lambda p: p.b || p.a)), 'string_agg', '')) AS proof_sha256, h AS folded_root, h = root AS verified
FROM folded WHERE k = len(path)
"""
