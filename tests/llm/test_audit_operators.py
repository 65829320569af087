"""op11, op12, op13 against plain Python on small tables with odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from hazardlens.llm import op11_source_audit as o11
from hazardlens.llm import op12_merkle_manifest as o12
from hazardlens.llm import op13_warc as o13
from pyspark.sql import functions as F

# --- op11 ------------------------------------------------------------------


def _audit(rows, min_docs=3, top=200):
    terms_of = lambda t: [w.translate({i: i + 32 for i in range(65, 91)}) for w in
                          re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    docs = [(terms_of(t), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {d[1] for d in docs}:
        here = [d for d in docs if d[1] == lang]
        kept = {w for w, n in Counter(w for d in here for w in set(d[0])).items() if n >= min_docs}
        counts = defaultdict(Counter)
        for words, _, source in here:
            counts[source].update(w for w in words if w in kept)
        whole = sum(counts.values(), Counter())
        p = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))
        for s, c in counts.items():
            pairs = [(o, sum((p(c, w) - p(d, w)) ** 2 // p(d, w) for w in kept)) for o, d in counts.items() if o != s]
            terms = [(w, (p(c, w) - p(whole, w)) ** 2 // p(whole, w)) for w in kept if c[w] and p(c, w) > p(whole, w)]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(items[:limit], 1)]
    return sorted(out)


def _texts(n=240):
    vocabulary = [f"{a}{b}" for a in ("sun", "Moon", "étoile", "日", "river", "x") for b in "abcdefghij"]
    rows = []
    for i in range(n):
        words = [vocabulary[(i * k * k + 7 * k + i // 5) % len(vocabulary)] for k in range(i % 37)]
        words += ["common"] * (i % 11) + [f"rare{'abcdef'[i % 6]}{'xyz'[i % 3]}"]
        rows.append((", ".join(words) if i % 2 else " ".join(words) + "_1.", ["en", "de", None][i % 3], f"s{min(i % 9, 4)}" if i % 13 else None))
    return rows + [(None, "en", "s0"), ("", "fr", "s1"), ("12 34 _", "fr", "s2"), ("only twice here", "", "s1"), ("common " * 5000, "en", "s4")]


SMALL_BLOCKS = [{}, {"block_rows": 20}, {"block_rows": 10**6, "cells": 600, "tile": 7}]


@pytest.mark.parametrize("parameters", SMALL_BLOCKS)
def test_audit_equals_plain_sums(spark, parameters):
    rows = _texts()
    docs = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n string")
    assert sorted(map(tuple, o11.audit(docs, **parameters).collect())) == _audit(rows)


def test_audit_keeps_ranks_of_terms_only(spark):
    rows = _texts()
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, o11.audit(docs, min_docs=1, top_terms=5).collect())) == _audit(rows, 1, 5)


def test_joint_tables_count_every_kept_term(spark):
    docs = spark.createDataFrame(_texts(), "text string, lang string, source string").cache()
    counts = o11.term_counts(docs)
    groups, _ = o11.group_sizes(docs, counts)
    tables = o11.joint_tables(o11.level_products(counts, groups, block_rows=30, cells=500, tile=5)).collect()
    n = {(r.lang, r.source, r.term): r.n for r in counts.collect()}
    terms = defaultdict(set)
    for lang, _, term in n:
        terms[lang].add(term)
    sources = defaultdict(set)
    for r in groups.collect():
        sources[r.lang].add(r.source)
    want = Counter((lang, a, b, n.get((lang, a, t), 0), n.get((lang, b, t), 0))
                   for lang, ts in terms.items() for t in ts for a in sources[lang] for b in sources[lang] if a < b)
    assert {(r.lang, r.source_a, r.source_b, r.level_a, r.level_b): r.terms for r in tables} == dict(want)


def test_large_counts_keep_whole_numbers(spark):
    n, size = 3 * 10**12, 7 * 10**12
    got = spark.range(1).select(o11.price(F.lit(n).cast("long"), F.lit(size).cast("long"))).first()[0]
    assert got == 1 + 10**9 * (n + 1) // size


def test_audit_of_nothing(spark, docs, empty):
    assert o11.audit(empty).count() == 0
    none = o11.audit(docs.select(F.lit(None).cast("string").alias("text"), "lang", "source")).collect()
    assert none and {(r.part, r.value) for r in none} == {("pair", 0)}


# --- op12 ------------------------------------------------------------------

def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _levels(nodes, arity=8):
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([_h(*now[i:i + arity]) for i in range(0, len(now), arity)])
    return levels


def _siblings(levels, at, arity=8):
    steps = []
    for level in levels[:-1]:
        lo = at // arity * arity
        steps.append(("".join(level[lo:at]), "".join(level[at + 1:lo + arity])))
        at //= arity
    return steps


def _manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {x: sorted(((r[0] is not None, r[0] or 0, _leaf(r), r) for r in rows if r[2] == x), key=lambda t: t[:3]) for x in langs}
    trees = {x: _levels([t[2] for t in g]) for x, g in groups.items()}
    top = _levels([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(groups[x]):
            steps = _siblings(trees[x], i) + _siblings(top, k)
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = text.translate({c: c + 32 for c in range(65, 91)})
            node = _leaf((*r[:4], text))
            for before, after in steps:
                node = _h(before, node, after)
            out.append((r[0], leaf, trees[x][-1][0], top[-1][0], _h(*(a + b for a, b in steps)), node, node == top[-1][0]))
    return sorted(out, key=repr)


ROWS = "doc_id long, source string, lang string, n_chars long, text string, path string, kids int, pos int, tops int"


def _saved(spark, folder, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], ROWS)
    return folder(documents=df)


def _documents(n):
    rows = [(i * 7 % 1009, f"s{i % 3}", ["en", "de", "日本", "", None][min(i % 11, 4)], i if i % 5 else None,
             f"Text {i} ÄB" if i % 6 else None) for i in range(n)]
    return rows + [(None, None, None, None, None), (None, "a", "en", 1, "A"), (3, "s", "en", 1, "One id"), (3, "s", "en", 1, "Other"),
                   (5, "s", "xx", 1, "Lone"), (9, "s", "en", 0, ""), (9, "s", "en", 0, ""), (12, "s", "de", 9, "LONG word " * 20_000)]


@pytest.mark.parametrize("n", [0, 60, 700])
def test_manifest_equals_plain_tree(spark, folder, n):
    rows = _documents(n)
    got = o12.op12_merkle_manifest(spark, _saved(spark, folder, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == _manifest(rows)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 63, 64, 65, 512, 513])
def test_blocks_of_any_depth_give_one_tree(spark, n):
    rows = [(i, "s", "en", i, f"T{i}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    m = o12.manifest(docs, digits=1 if n > 64 else 2)
    m = m.select("doc_id", "leaf", "subroot", "root", o12.digest(o12.proof_text(F.col("proof"))).alias("proof"),
                 o12.folded(F.col("leaf"), F.col("proof")).alias("folded"))
    want = {r[0]: r[1:5] for r in _manifest(rows)}
    got = {r.doc_id: tuple(r)[1:5] for r in m.collect()}
    assert got == want
    assert all(r.folded == r.root for r in m.collect())


def test_manifest_of_nothing(spark, folder, empty):
    assert o12.op12_merkle_manifest(spark, folder(documents=empty)).count() == 0


# --- op13 ------------------------------------------------------------------

PAGES = "page_id long, url string, html string, payload string, digest string, first_id int"


def _page_rows():
    same, other = "<p>" + "hot page " * 40 + "</p>", "x" * 99
    rows = [(i, f"http://h/{i}", same) for i in range(40, 140)] + [(i, f"http://h/{i}", other) for i in range(5)]
    return rows + [(200, "http://a/ b\r\nWARC/1.1", "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n</p>" + "é日" * 50),
                   (201, None, None), (202, "", ""), (203, "http://big", "long " * 400_000), (204, "u", "y" * 100), (205, "v", "y" * 100),
                   (206, "same", "z" * 120), (206, "same", "z" * 120), (207, "w", "z" * 120), (None, "no id", "z" * 120),
                   (None, "no id", "q" * 120), (None, "none", "q" * 120)]


def _warc(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        ids = [p for p, _, h in rows if h == html and p is not None]
        copy = len(data) >= 100 and bool(ids) and page != min(ids)
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if copy else "response", min(ids) if copy else None))
    return sorted(out, key=repr)


def test_archives_hold_every_page(spark, folder):
    rows = _page_rows()
    pages = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], PAGES).repartition(3)
    got = o13.op13_warc(spark, folder(pages=pages))
    assert sorted(map(tuple, got.collect()), key=repr) == _warc(rows)


def test_pages_come_back_as_they_were(spark, tmp_path):
    rows = _page_rows()
    path = str(tmp_path / "warc")
    o13.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path, archive_bytes=200_000)
    found = o13.captures(o13.read_records(spark, path))
    back = o13.pages_of(found).collect()
    html = {r.payload_digest: r.payload for r in back if r.payload is not None}
    assert sorted(((r.page_id, r.url, html[r.payload_digest]) for r in back), key=repr) == \
        sorted(((p, u, h or "") for p, u, h in rows), key=repr)
    assert len(list((tmp_path / "warc").glob("part-*"))) > 3


def test_captures_join_their_three_records(spark, tmp_path):
    path = str(tmp_path / "warc")
    rows = _page_rows()
    o13.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    records = o13.read_records(spark, path)
    assert records.count() == 3 * len(rows)
    assert records.select("record_id").distinct().count() == 3 * len(rows)
    found = o13.captures(records)
    ids = found.select("capture.record_id", F.col("request.concurrent_to").alias("a"), F.col("metadata.concurrent_to").alias("b")).collect()
    assert len(ids) == len(rows) and all(r.record_id == r.a == r.b for r in ids)
    # A revisit of a payload whose first page is single names this page's record.
    named = {r.record_id for r in records.where("record_type = 'response'").collect()}
    refers = [r.refers_to for r in records.where("record_type = 'revisit'").collect()]
    assert sum(r in named for r in refers) == 99 + 1  # copies of the hot page and of 204
    # A second request is a row of its own: nothing is dropped by the join.
    more = records.unionByName(records.where("record_type = 'request'").limit(1))
    assert o13.captures(more).count() == len(rows) + 1


def test_archives_are_plain_warc(spark, tmp_path):
    path = tmp_path / "warc"
    o13.write_archives(spark.createDataFrame([(1, "http://h/é", "<p>é</p>")], "page_id long, url string, html string"), str(path))
    data = b"".join(f.read_bytes() for f in sorted(path.glob("part-*")))
    assert data.count(b"WARC/1.1\r\n") == 3 and data.endswith(b"\r\n\r\n")
    for kind in (b"request", b"response", b"metadata"):
        assert b"WARC-Type: " + kind + b"\r\n" in data
    assert "\r\n\r\n<p>é</p>\r\n\r\n".encode() in data


def test_cut_off_archives_are_refused(spark, tmp_path):
    path = tmp_path / "warc"
    o13.write_archives(spark.createDataFrame([(1, "u", "page " * 100)], "page_id long, url string, html string"), str(path))
    part = next(f for f in path.glob("part-*") if f.stat().st_size)
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc").write_bytes(part.read_bytes()[:-300])
    with pytest.raises(Exception, match="cut off"):
        o13.read_records(spark, str(tmp_path / "cut")).collect()


def test_changed_payloads_are_noticed(spark, tmp_path):
    path = tmp_path / "warc"
    o13.write_archives(spark.createDataFrame([(1, "u", "page " * 100)], "page_id long, url string, html string"), str(path))
    part = next(f for f in path.glob("part-*") if f.stat().st_size)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.warc").write_bytes(part.read_bytes().replace(b"page page", b"page PAGE", 1))
    with pytest.raises(Exception, match="does not match"):
        o13.pages_of(o13.captures(o13.read_records(spark, str(tmp_path / "bad")))).collect()


def test_archives_of_nothing(spark, folder):
    assert o13.op13_warc(spark, folder(pages=spark.createDataFrame([], PAGES))).count() == 0
