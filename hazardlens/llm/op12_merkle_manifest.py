"""Merkle manifest of a table: a digest per row, a root, and a proof per row.

A row's leaf is the SHA-256 (lowercase hex) of its fields, each ``-`` if null,
else its UTF-8 byte count, ``:`` and its value. Per language, leaves ascend by
doc_id; every ``ARITY`` consecutive nodes become the digest of their
concatenated hex digests, until one node, the subroot, remains. Subroots in the
order of languages become the root likewise.

Nested-struct rollup: a row's rank in its language is read as digits to the
base ``ARITY``. Blocks of ``ARITY ** DIGITS`` consecutive rows are dealt to one
place once; there one digit after the other is grouped away, the children
nested into their parent, without further shuffles. A block's digest is a node
of the next tier, rolled up alike; each tier has 4096 times fewer rows, and a
task never holds more than one block. On the way down, ``transform`` and
``inline`` unfold the nested children with the siblings left and right of each;
a block's own path from above arrives as one more row of its group. No step of
this joins rows to rows.

A proof of a row is the list of sibling digests from its leaf to the root, each
level as (before, after). Folding a leaf with its proof gives the root if, and
only if, the row is unchanged.

Ranks come from one range partitioning by (language, doc_id, leaf), so a
language with any share of the rows spans many tasks. Defined results: null
doc_ids come first in their language and are never tampered with; rows with the
same doc_id are ordered by leaf; wholly repeated rows are leaves of their own,
with different proofs. Null languages form a tree of their own, before ''.
Fields other than the five are neither read nor returned. An empty table gives
no rows (there is no root). A table with one row has this row's leaf as root
and a proof without siblings (digest of '').
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.operators.running import running_sums

from .common import stored, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY_BITS = 3   # 8 children per node
DIGITS = 4       # digits grouped away inside one block: 8 ** 4 = 4096 rows


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """``-`` if null, else byte count, ``:``, value."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf(values: dict, fields=FIELDS) -> Column:
    return digest(F.concat(*[field(values[f]) for f in fields]))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, node, tampered): leaf of each row, and the leaf of its
    tampered copy where 3 divides the CRC-32 of its decimal id (else null)."""
    values = {f: F.col(f) for f in FIELDS}
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = leaf(values | {"text": lower_ascii(F.col("text"))})
    return docs.select(F.col("lang").alias("tree"), "doc_id", leaf(values).alias("node"),
                       F.when(chosen, changed).alias("tampered"))


def placed(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``pos``, their 0-based rank in their tree, in ``order``."""
    names = [c for c in rows.columns]
    every = running_sums(rows.withColumn("_one", F.lit(1)), [F.asc_nulls_first("tree"), *order], {"_at": "_one"})
    every = stored(every.drop("_one"), "manifest-placed")
    starts = every.groupBy(F.col("tree").alias("_tree")).agg(F.min("_at").alias("_start"))  # one row per tree
    return (every.join(starts, F.col("tree").eqNullSafe(F.col("_tree")))
            .select(*names, (F.col("_at") - F.col("_start")).alias("pos")))


def rolled_up(nodes: DataFrame, bits: int = ARITY_BITS, digits: int = DIGITS) -> DataFrame:
    """Blocks (tree, block, node, kids) of nodes (tree, pos, node, others): the
    last digits of ``pos`` are grouped away one by one. ``kids`` nests the
    children; at the lowest level they carry the other columns.

    A parent at position 0 with a single child is no node of its own: the
    child is all that is left of its tree and keeps its digest.
    """
    now = nodes.withColumn("block", F.shiftright("pos", bits * digits)).repartition("tree", "block")
    for _ in range(digits):
        kept = [F.col(c) for c in now.columns if c not in ("tree", "block", "pos")]
        now = now.groupBy("tree", "block", F.shiftright("pos", bits).alias("up")).agg(
            F.sort_array(F.collect_list(F.struct("pos", *kept))).alias("kids"))
        alone = (F.size("kids") == 1) & (F.col("up") == 0)
        node = F.when(alone, F.col("kids")[0]["node"]).otherwise(digest(F.array_join(F.col("kids")["node"], "")))
        now = now.select("tree", "block", F.col("up").alias("pos"), node.alias("node"), "kids")
    return now.select("tree", "block", "node", "kids")


def unfolded(blocks: DataFrame, digits: int = DIGITS) -> DataFrame:
    """The rows at the bottom of blocks (tree, block, kids, path, tops): their
    ``pos`` and other columns, ``tops`` and ``path``, siblings from bottom to top."""
    now = blocks.select("tree", "tops", "path", F.shiftleft("block", 0).alias("up"), "kids")
    for level in range(digits):
        alone = (F.size("kids") == 1) & (F.col("up") == 0)

        def beside(kid, i):
            nodes = F.col("kids")["node"]
            before = F.array_join(F.slice(nodes, F.lit(1), i), "")
            after = F.array_join(F.slice(nodes, i + 2, F.size("kids")), "")
            return F.struct(kid.alias("kid"), F.struct(before.alias("before"), after.alias("after")).alias("step"))

        now = (now.withColumn("_alone", alone)
               .select("tree", "tops", "path", "_alone", F.inline(F.transform("kids", beside)))
               .withColumn("path", F.when(F.col("_alone"), F.col("path")).otherwise(F.concat(F.array("step"), F.col("path")))))
        if level < digits - 1:
            now = now.select("tree", "tops", "path", F.col("kid.pos").alias("up"), F.col("kid.kids").alias("kids"))
    return now.select("tree", "tops", "path", "kid.*")


def with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """``blocks`` with (path, tops) of the row of ``paths`` of the same (tree,
    block): both kinds of rows meet in one group."""
    kind = {f.name: f.dataType for f in [*blocks.schema, *paths.schema]}
    blank = lambda c: F.lit(None).cast(kind[c]).alias(c)
    rows = (blocks.select("tree", "block", "kids", blank("path"), blank("tops"))
            .unionByName(paths.select("tree", "block", blank("kids"), "path", "tops")))
    return rows.groupBy("tree", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("kids", "path", "tops")])


def _tiers(nodes: DataFrame, name: str, bits: int, digits: int) -> list:
    """Blocks of ``nodes``, blocks of these, and so on up to one per tree. Each
    tier is written; their number is the logarithm of the largest tree."""
    tiers = []
    while True:
        tiers.append(stored(rolled_up(nodes, bits, digits), name))
        last = tiers[-1].agg(F.max("block")).first()[0]
        if not last:
            return tiers
        nodes = tiers[-1].select("tree", F.col("block").alias("pos"), "node")


def _down(tiers: list, paths: DataFrame, digits: int) -> DataFrame:
    """Rows of the lowest tier with their whole path, given the trees' own."""
    for tier in reversed(tiers):
        rows = unfolded(with_paths(tier, paths), digits)
        paths = rows.select("tree", F.col("pos").alias("block"), "path", "tops")
    return rows


def manifest(docs: DataFrame, bits: int = ARITY_BITS, digits: int = DIGITS) -> DataFrame:
    """Per row: doc_id, leaf, tampered leaf (or null), subroot, root and
    ``proof``, an array of (before, after) from the leaf to the root."""
    tiers = _tiers(placed(leaves(docs), [F.asc_nulls_first("doc_id"), F.col("node")]), "manifest-tier", bits, digits)
    subroots = tiers[-1].select("tree", F.col("node").alias("subroot"))
    # The trees' roots are the leaves of one last tree.
    ranked = running_sums(subroots.withColumn("_one", F.lit(1)), [F.asc_nulls_first("tree")], {"_at": "_one"})
    top = _tiers(ranked.select(F.lit("").alias("tree"), (F.col("_at") - 1).alias("pos"), F.col("subroot").alias("node"),
                               F.col("tree").alias("lang")), "manifest-top", bits, digits)
    step = "array<struct<before:string,after:string>>"
    start = top[-1].select("tree", F.lit(0).cast("long").alias("block"), F.array().cast(step).alias("path"),
                           F.struct(F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root")).alias("tops"))
    langs = _down(top, start, digits)
    paths = langs.select(F.col("lang").alias("tree"), F.lit(0).cast("long").alias("block"), "path",
                         F.struct(F.col("node").alias("subroot"), F.col("tops.root").alias("root")).alias("tops"))
    rows = _down(tiers, paths, digits)
    return rows.select("doc_id", F.col("node").alias("leaf"), "tampered", "tops.subroot", "tops.root", F.col("path").alias("proof"))


def proof_text(proof) -> Column:
    """All sibling digests, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


def folded(node: Column, proof) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, node, lambda acc, s: digest(F.concat(s["before"], acc, s["after"])))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(table(spark, sf_dir, "documents"))
    m = m.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return m.select("doc_id", "leaf", "subroot", "root", digest(proof_text(F.col("proof"))).alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


# DuckDB twin: trees, siblings and folds by recursive CTEs; CRC-32 bit by bit.
ORACLE_SQL = r"""
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS id, doc_id, lang, text,
         concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-')) AS head,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents),
crc(id, rest, c) AS (
  SELECT id, doc_id::VARCHAR, 4294967295::BIGINT FROM f WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT id, substr(rest, 2), list_reduce(list_concat([xor(c, ascii(rest[1])::BIGINT)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
         lambda x, y: xor(x >> 1, (x & 1) * 3988292384::BIGINT)) FROM crc WHERE rest <> ''),
hit AS (SELECT id FROM crc WHERE rest = '' AND xor(c, 4294967295::BIGINT) % 3 = 0),
lf AS (SELECT f.id, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
              sha256(head || coalesce(CASE WHEN hit.id IS NULL THEN strlen(text) || ':' || text
                                           ELSE strlen(low) || ':' || low END, '-')) AS seen
       FROM f LEFT JOIN hit ON f.id = hit.id),
pl AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
              row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
              count(*) OVER (PARTITION BY lang) - 1 AS last FROM lf),
up(tree, lvl, pos, last, h) AS (
  SELECT tree, 0, pos, last, leaf FROM pl
  UNION ALL
  SELECT tree, lvl + 1, pos // 8, last // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE last > 0
  GROUP BY tree, lvl, pos // 8, last),
sub AS (SELECT tree, h FROM up WHERE last = 0),
top(lvl, pos, last, h) AS (
  SELECT 0, tree, (SELECT max(tree) FROM sub), h FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 8, last // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE last > 0
  GROUP BY lvl, pos // 8, last),
bes AS (SELECT tree, lvl, pos,
               coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
               coalesce(string_agg(h, '') OVER (PARTITION BY tree, lvl, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
        FROM up WHERE last > 0),
tbes AS (SELECT lvl, pos,
                coalesce(string_agg(h, '') OVER (PARTITION BY lvl, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
                coalesce(string_agg(h, '') OVER (PARTITION BY lvl, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
         FROM top WHERE last > 0),
fold(id, tree, lvl, pos, acc, proof) AS (
  SELECT id, tree, 0, pos, seen, '' FROM pl
  UNION ALL
  SELECT id, fold.tree, fold.lvl + 1, fold.pos // 8, sha256(a || acc || b), proof || a || b
  FROM fold JOIN bes ON bes.tree = fold.tree AND bes.lvl = fold.lvl AND bes.pos = fold.pos),
mid AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY id ORDER BY lvl DESC) = 1),
tfold(id, lvl, pos, acc, proof) AS (
  SELECT id, 0, tree, acc, proof FROM mid
  UNION ALL
  SELECT id, tfold.lvl + 1, tfold.pos // 8, sha256(a || acc || b), proof || a || b
  FROM tfold JOIN tbes ON tbes.lvl = tfold.lvl AND tbes.pos = tfold.pos),
fin AS (SELECT * FROM tfold QUALIFY row_number() OVER (PARTITION BY id ORDER BY lvl DESC) = 1)
SELECT pl.doc_id, pl.leaf, sub.h AS subroot, r.h AS root, sha256(fin.proof) AS proof_sha256,
       fin.acc AS folded_root, fin.acc = r.h AS verified
FROM pl JOIN sub ON sub.tree = pl.tree JOIN fin ON fin.id = pl.id CROSS JOIN (SELECT h FROM top WHERE last = 0) r
"""
