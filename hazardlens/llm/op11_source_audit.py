"""Source divergence audit by one-hot level products.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased. Each
language keeps the terms found in at least ``MIN_DOCS`` of its documents. A
(lang, source) group gives a kept term with ``n`` occurrences the price
p = 1 + floor(SCALE * (n + 1) / (N + V)): N occurrences of kept terms in the
group, V kept terms of the language; the language as a whole prices alike. The
divergence of p from q is floor((p - q)^2 / q), all in whole numbers.

Prices depend on a count only, so terms with equal counts in two groups can be
priced at once. Every (group, count) that occurs is an indicator column over
the terms; the product of this 0/1 matrix with its transpose holds, for each
pair of columns, the number of terms with these two counts: all joint tables of
all pairs of groups. The product is a sum over blocks of terms. A block holds
terms of like frequency, hence few columns; inside a task it is halved until
its matrix has at most ``CELLS`` entries and is multiplied in tiles of ``TILE``
columns. Entries are whole numbers far below 2**53, so the products are exact.

Spark counts, keeps terms, forms the blocks and sums the priced cells; no task
holds more than one block. A language or source with a third of all rows is
spread by terms, a frequent term is summed before it is shuffled.

Null text, language and source are read as ''. Every row is a document, also
one with a repeated or null id; other columns are not read. Empty texts and
texts without terms still count as a group of their source. A language without
kept terms (V = 0) has divergence 0 for all pairs and no rows of part ``term``.
An empty table gives no rows. Ties rank by the item's UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table

MIN_DOCS = 3            # documents of its language that a kept term occurs in
SCALE = 1_000_000_000   # prices are shares of this
TOP_TERMS = 200         # ranks returned per group in part "term"
FLUSH = 100_000         # (group, term) entries a counting task holds before it emits them
BLOCK_ROWS = 50_000     # (term, source) entries of a block, on average
CELLS = 4_000_000       # entries of one indicator matrix (8 bytes each)
TILE = 1024             # columns of a tile of the product

_TERM = re.compile(rb"[a-z\x80-\xff]+")  # of the lower-cased UTF-8 bytes
_COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                        T.StructField("term", T.StringType()), T.StructField("n", T.LongType()),
                        T.StructField("docs", T.LongType())])


def _count_batches(batches):
    held: dict = {}
    entries = 0

    def flush():
        rows = [(lang, source, term, n, docs[term]) for (lang, source), (all_, docs) in held.items()
                for term, n in all_.items()]
        cols = list(zip(*rows)) if rows else [()] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()),
             pa.array(cols[2], pa.binary()).cast(pa.string()), pa.array(cols[3], pa.int64()),
             pa.array(cols[4], pa.int64())], names=_COUNTS.names)

    for b in batches:
        texts = b.column(0).cast(pa.binary())
        for text, lang, source in zip(texts, b.column(1).to_pylist(), b.column(2).to_pylist()):
            if (lang, source) not in held:
                held[lang, source] = (Counter(), Counter())
            all_, docs = held[lang, source]
            before = len(docs)
            terms = _TERM.findall(text.as_py().lower())
            all_.update(terms)
            docs.update(set(terms))
            entries += len(docs) - before
            if entries > FLUSH:
                yield flush()
                held.clear()
                entries = 0
    yield flush()


def _read(docs: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return docs.select(blank("text"), blank("lang"), blank("source"))


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, source, n, total, first) of kept terms: occurrences in the
    group and in the language; ``first`` marks one row per (lang, term)."""
    rows = _read(docs).mapInArrow(_count_batches, _COUNTS)
    # Rows are summed per task already; dealing them by (lang, term) serves the
    # counts per source and the document counts per language in one shuffle.
    counts = (rows.repartition("lang", "term").groupBy("lang", "term", "source")
              .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    term = Window.partitionBy("lang", "term")
    return (counts.withColumn("_docs", F.sum("docs").over(term)).withColumn("total", F.sum("n").over(term))
            .withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
            .where(F.col("_docs") >= min_docs).select("lang", "term", "source", "n", "total", "first"))


def price(n: Column, size: Column, scale: int = SCALE) -> Column:
    """1 + floor(scale * (n + 1) / size) in whole numbers of any length."""
    whole = lambda c: c.cast("decimal(19,0)")
    up = F.lit(scale).cast("decimal(12,0)") * whole(n + F.lit(1))
    return F.lit(1).cast("long") + F.call_function("div", up, whole(size))


def divergence(p: str, q: str) -> Column:
    """floor((p - q)^2 / q); prices stay below 2**31, squares below 2**62."""
    d = F.col(p) - F.col(q)
    return F.call_function("div", d * d, F.col(q))


def group_sizes(docs: DataFrame, counts: DataFrame, scale: int = SCALE) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, size, p0), p0 being the price of an absent term,
    and languages (lang, terms, lang_size); sizes are N + V."""
    langs = counts.groupBy("lang").agg(F.sum("n").alias("_n"), F.count_if("first").alias("terms"))
    langs = stored(langs.select("lang", "terms", (F.col("_n") + F.col("terms")).alias("lang_size")), "audit-langs")
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("_n"))
    groups = (_read(docs).groupBy("lang", "source").agg(F.lit(1).alias("_one"))
              .join(sums, ["lang", "source"], "left").join(langs, "lang", "left"))
    size = F.coalesce("_n", F.lit(0)) + F.coalesce("terms", F.lit(0))
    groups = groups.select("lang", "source", size.alias("size"))
    p0 = F.when(F.col("size") > 0, price(F.lit(0).cast("long"), F.col("size"), scale))
    return stored(groups.withColumn("p0", p0), "audit-groups"), langs


def blocks(counts: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``counts`` with (lang, class, slot): blocks of terms of like frequency.
    Classes hold terms within half a power of two; each has as many slots as
    its rows need, and terms are dealt to them by hash."""
    c = counts.withColumn("class", F.floor(F.log2("total") * 2).cast("int"))
    # Written, so its size is known when the join is planned: a small table is
    # broadcast, and the counts are not dealt by language and class.
    slots = stored(c.groupBy("lang", "class").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("_slots")), "audit-slots")
    return (c.join(slots, ["lang", "class"])
            .withColumn("slot", F.pmod(F.xxhash64("term"), F.col("_slots"))).drop("_slots"))


_CELLS = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("source_a", T.StringType()),
    T.StructField("source_b", T.StringType()), T.StructField("level_a", T.LongType()),
    T.StructField("level_b", T.LongType()), T.StructField("price_a", T.LongType()),
    T.StructField("price_b", T.LongType()), T.StructField("terms", T.LongType())])


def _products(levels: np.ndarray, owner: np.ndarray, cells: int, tile: int):
    """Of terms x groups ``levels`` (indicator column per entry, ``owner``: its
    group), all (column, column, terms) of pairs of groups a < b."""
    todo = [levels]
    while todo:
        part = todo.pop()
        cols, at = np.unique(part, return_inverse=True)
        at = at.reshape(part.shape)
        if len(part) > 16 and (part.shape[0] * len(cols) > cells or len(cols) > max(tile, 4 * part.shape[1])):
            todo += [part[:len(part) // 2], part[len(part) // 2:]]
            continue
        # Columns are numbered by group, so tiles left of the diagonal hold no new pair.
        edges = range(0, len(cols), tile)
        hot = [np.zeros((len(part), min(tile, len(cols) - lo))) for lo in edges] if len(part) * len(cols) <= 4 * cells else None

        def indicators(i):
            if hot is not None and hot[i].any():
                return hot[i]
            lo = edges[i]
            x = hot[i] if hot is not None else np.zeros((len(part), min(tile, len(cols) - lo)))
            row, col = np.nonzero((at >= lo) & (at < lo + tile))
            x[row, at[row, col] - lo] = 1.0
            return x

        for i in range(len(edges)):
            for j in range(i, len(edges)):
                joint = indicators(i).T @ indicators(j)
                a, b = np.nonzero(joint)
                left, right = cols[a + edges[i]], cols[b + edges[j]]
                keep = owner[left] < owner[right]
                yield left[keep], right[keep], joint[a[keep], b[keep]].astype(np.int64)


def _block_tables(cells: int, tile: int):
    def run(rows: pa.Table) -> pa.Table:
        lang = rows["lang"][0]
        zero = rows.filter(rows["term"].is_null()).sort_by("source")   # one row per group of the language
        seen = rows.filter(rows["term"].is_valid())
        sources = zero["source"].combine_chunks()
        n_groups = len(sources)
        term = seen["term"].combine_chunks().dictionary_encode()
        terms = term.indices.to_numpy()
        group = pa.compute.index_in(seen["source"], value_set=sources).to_numpy()
        level, cost = seen["n"].to_numpy(), seen["p"].to_numpy()
        # Indicator columns: (group, level), numbered by group, level 0 first.
        pairs = np.concatenate([np.stack([np.arange(n_groups), np.zeros(n_groups, np.int64)], 1),
                                np.stack([group, level], 1)])
        columns, first, at = np.unique(pairs, axis=0, return_index=True, return_inverse=True)
        prices = np.concatenate([zero["p"].to_numpy(), cost])[first]
        at = at.reshape(-1)
        levels = np.tile(at[:n_groups], (len(term.dictionary), 1))
        levels[terms, group] = at[n_groups:]
        # Rows in the order of their largest count, so halves need fewer columns each.
        levels = levels[np.argsort(columns[levels, 1].max(axis=1), kind="stable")]
        out = [np.concatenate(c) for c in zip(*_products(levels, columns[:, 0], cells, tile))]
        left, right, count = out if out else (np.zeros(0, np.int64),) * 3
        name = lambda c: sources.take(pa.array(columns[c, 0]))
        return pa.table({"lang": pa.repeat(lang, len(left)).cast(pa.string()), "source_a": name(left), "source_b": name(right),
                         "level_a": columns[left, 1], "level_b": columns[right, 1],
                         "price_a": prices[left], "price_b": prices[right], "terms": count})

    return run


def level_products(counts: DataFrame, groups: DataFrame, block_rows: int = BLOCK_ROWS, cells: int = CELLS,
                   tile: int = TILE, scale: int = SCALE) -> DataFrame:
    """Cells of the joint tables, block by block: (lang, source_a < source_b,
    level_a, level_b, price_a, price_b, terms). Cells of different blocks add up."""
    keys = ["lang", "class", "slot"]
    b = blocks(counts, block_rows).join(groups.select("lang", "source", "size"), ["lang", "source"])
    seen = b.select(*keys, "source", "term", "n", price(F.col("n"), F.col("size"), scale).alias("p"))
    # Each block also gets a row per group of its language: level 0.
    zero = b.select(*keys).distinct().join(groups, "lang").select(
        *keys, "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.col("p0").alias("p"))
    return seen.unionByName(zero).repartition(*keys).groupBy(*keys).applyInArrow(_block_tables(cells, tile), _CELLS)


def joint_tables(products: DataFrame) -> DataFrame:
    """Joint tables: terms of ``lang`` with ``level_a`` occurrences in source_a
    and ``level_b`` in source_b, for every pair of sources a < b."""
    return (products.groupBy("lang", "source_a", "source_b", "level_a", "level_b")
            .agg(F.sum("terms").alias("terms")))


def pair_divergences(products: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of sources of a
    language: the item's divergence as q from the source's p, over all kept terms."""
    sums = (products.withColumn("_ab", F.col("terms") * divergence("price_a", "price_b"))
            .withColumn("_ba", F.col("terms") * divergence("price_b", "price_a"))
            .groupBy("lang", "source_a", "source_b").agg(F.sum("_ab").alias("_ab"), F.sum("_ba").alias("_ba")))
    both = F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item"), F.col("_ab").alias("value")),
                   F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"), F.col("_ba").alias("value")))
    priced = sums.select("lang", F.inline(both))
    # Languages without kept terms have no cells; the result lists their pairs with 0.
    bare = groups.where("size = 0").select("lang", "source")
    none = (bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item")
            .select("lang", "source", "item", F.lit(0).cast("long").alias("value")))
    return priced.unionByName(none)


def term_divergences(counts: DataFrame, groups: DataFrame, langs: DataFrame, scale: int = SCALE) -> DataFrame:
    """(lang, source, item, value) of terms that a source uses more than its language."""
    d = counts.join(groups.select("lang", "source", "size"), ["lang", "source"]).join(langs, "lang")
    d = d.withColumn("_p", price(F.col("n"), F.col("size"), scale)).withColumn("_q", price(F.col("total"), F.col("lang_size"), scale))
    return d.where("_p > _q").select("lang", "source", F.col("term").alias("item"), divergence("_p", "_q").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, **parameters) -> DataFrame:
    """(lang, source, part, item, value, rank); see the module's description."""
    counts = stored(term_counts(docs, min_docs), "audit-counts")
    groups, langs = group_sizes(docs, counts)
    pairs = pair_divergences(level_products(counts, groups, **parameters), groups)
    terms = term_divergences(counts, groups, langs)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (pairs.withColumn("part", F.lit("pair")).withColumn("rank", rank).select(*columns)
            .unionByName(terms.withColumn("part", F.lit("term")).withColumn("rank", rank)
                         .where(F.col("rank") <= top_terms).select(*columns)))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


# DuckDB twin. Whole-number division is //, prices are HUGEINT.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
           FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term
      GROUP BY t.lang, t.source, t.term),
l AS (SELECT lang, count(*) AS v, sum(total) AS nl FROM k GROUP BY lang),
g AS (SELECT a.lang, a.source, coalesce(b.n, 0) + coalesce(l.v, 0) AS size, l.v + l.nl AS lang_size
      FROM (SELECT DISTINCT lang, source FROM d) a
      LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) b
        ON a.lang = b.lang AND a.source = b.source
      LEFT JOIN l ON a.lang = l.lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // g.size::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (k.total + 1)) // g.lang_size::HUGEINT AS q
      FROM g JOIN k ON g.lang = k.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
         GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(pair.value, 0)::BIGINT AS value
          FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
          LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value
          FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
