"""Operators against brute force on the smallest tables and on odd rows."""

import collections
import hashlib
import re
import sys
import zlib

import numpy as np
import oracle
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from veilgrain.llm import (
    fingerprints,
    graph,
    knn,
    licenses,
    minhash,
    mixing,
    packing,
    quality,
    queries,
    rollups,
    tokenfiles,
    tokens,
    urlfilter,
)
from veilgrain.session import run_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, length int, v int, rank int"
LONG = " ".join(f"w{i % 997}q{i % 89}" for i in range(30000))
ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n", "en", "a"),
    (4, "one", "en", "b"),
    (5, "one two", "en", "b"),
    (6, "One two three four five six seven", "de", None),
    (7, "one TWO three four five six seven", "de", "a"),
    (8, LONG, "en", "a"),
    (9, LONG + " tail", "en", "c"),
    (None, "a text without an id", "en", "c"),
    (None, None, None, "c"),
    (4, "one", "en", "b"),
    (10, "naïve \U0001f600 text\nReleased under the MIT Licence!", "fr", ""),
]


def odd_docs(spark):
    rows = [(i, t, g, s, len(t or ""), 1, 2, 3) for i, t, g, s in ODD]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark):
    return queries.table(spark, SMALL, "documents")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, n):
    words = WORD.findall(lowered(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute_components(rows, n, percent):
    sets = {d: shingle_set(t, n) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert oracle.compare(spark, duck, queries.QUERIES[name], queries.ORACLES[name], SMALL) == []


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 300, (220, 2))] + [(500 + i, 501 + i) for i in range(60)]
    edges += [(900, 900 + i) for i in range(1, 50)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_like_brute_force(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = minhash.near_duplicates(docs, 3, 85).collect()
    want = brute_components(rows, 3, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(rows)


def test_near_duplicates_in_long_lists(spark, monkeypatch):
    # copies of one text with few or many edits: lists longer than a block, links that no star finds
    monkeypatch.setattr(minhash, "SHORT_LIST", 16)
    rng = np.random.default_rng(6)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for d in range(90):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            words[at] = f"e{d}x{at}"
        rows.append((d, " ".join(words)))
    rows += [(1000 + d, " ".join(base[:50]) + f" u{d} " + " ".join(f"z{d}w{i}" for i in range(60))) for d in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs, 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 3, 85)


def test_near_duplicates_of_odd_rows(spark):
    got = minhash.near_duplicates(odd_docs(spark), 5, 80).collect()
    assert len(got) == len(ODD)
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[7][0]["component_id"] == 6 and not by[7][0]["kept"] and by[9][0]["component_id"] == 8
    assert [r["kept"] for r in by[4]] == [True, True] and by[1][0]["n_shingles"] == 0 and by[1][0]["kept"]
    assert all(r["kept"] and r["component_id"] is None for r in by[None])
    assert minhash.near_duplicates(no_docs(spark)).count() == 0
    kept = minhash.deduplicate(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 6, 8, 10]


def test_texts_under_one_id_stay(spark):
    def words(tag):
        return " ".join(f"{tag}{i}" for i in range(40))

    rows = [(1, words("a")), (1, words("b")), (1, words("b") + " b99"), (1, words("a")), (2, words("c")), (3, words("c")),
            (3, words("d")), (None, words("a")), (None, words("e")), (None, words("e"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["text"][0]) for r in minhash.deduplicate(docs, shingle_words=5, percent=80).collect())
    assert got == collections.Counter([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")])


def check_packing(rows, texts, limit=1024):
    encode = tokens.encoder(tokens.default_path()).encode
    want = collections.Counter()
    for doc_id, ids in zip(texts, encode(list(t for _, t in texts))):
        ids = np.append(ids, 2).astype("<u4")
        first = (len(ids) - 1) % limit + 1
        for k, at in enumerate([0, *range(first, len(ids), limit)]):
            part = ids[at : first if not at else at + limit]
            want[doc_id[0], k, at, len(part), zlib.crc32(part.tobytes())] += 1
    got = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert got == want
    held = collections.defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
        if "ids" in r:
            assert zlib.crc32(r["ids"]) == r["ids_crc32"]
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(held)


def test_packing(spark):
    docs = documents(spark)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = packing.pack(docs, tokens.default_path()).collect()
    n = check_packing(rows, texts)
    assert n <= 1.03 * sum(r["length"] for r in rows) / 1024 + 1
    check_packing(packing.pack(odd_docs(spark), tokens.default_path()).collect(), [(i, t) for i, t, _, _ in ODD])
    assert packing.pack(no_docs(spark), tokens.default_path()).count() == 0


def test_token_files(spark):
    for docs in (documents(spark), odd_docs(spark)):
        folder = run_folder(spark, "test-tokens")
        tokenfiles.write(docs, folder, tokens.default_path())
        got = sorted(map(tuple, tokenfiles.documents(spark, folder).collect()), key=lambda r: r[1])
        rows = docs.selectExpr("doc_id", "text", "xxhash64(text) h").collect()
        rows = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
        want, at = [], 0
        for r, ids in zip(rows, tokens.encoder(tokens.default_path()).encode([r["text"] for r in rows])):
            ids = np.append(ids, 0).astype("<u4")
            want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert got == want
    folder = run_folder(spark, "test-tokens")
    tokenfiles.write(no_docs(spark), folder, tokens.default_path())
    assert tokenfiles.documents(spark, folder).count() == 0


def test_damaged_block_is_found(spark):
    import pyarrow as pa

    from veilgrain.llm import rangecoder

    ids = np.arange(500, dtype=np.uint32)
    data = rangecoder.encode([ids])[0]
    names = ["part", "block", "n_ids", "docs", "data", "crc32"]
    row = [[0], [0], [500], [rangecoder.pack_docs([1], [500], [0])], [data[:50] + b"\0\1\2\3" + data[54:]], [
        zlib.crc32(ids.astype("<u4").tobytes())]]
    with pytest.raises(ValueError, match="damaged"):
        list(tokenfiles.segment_rows(iter([pa.record_batch(row, names=names)]), True))


def test_fingerprints_of_edits(spark):
    for docs, count in ((documents(spark), 8), (odd_docs(spark), 1), (odd_docs(spark).limit(1), 1)):
        rows = docs.selectExpr("doc_id", "coalesce(text, '') text", "xxhash64(coalesce(text, '')) h").collect()
        rows = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["h"]))
        per = max(1, len(rows) // count)
        got = fingerprints.edit_robustness(docs, rows_per_bucket=per).collect()
        f = fingerprints.fingerprint
        want = collections.Counter()
        for r, n in zip(rows, rows[1:] + rows[:1]):
            new = fingerprints.edited(r["text"], n["text"])
            want[(
                r["doc_id"], len(r["text"]), hashlib.sha256(new.encode()).hexdigest(), f(r["text"]), f(new),
                fingerprints.likeness(f(r["text"]), f(new)), fingerprints.likeness(f(r["text"]), f(n["text"])),
            )] += 1
        assert collections.Counter(map(tuple, got)) == want
    assert fingerprints.edit_robustness(no_docs(spark)).count() == 0
    assert fingerprints.fingerprints(odd_docs(spark)).count() == len(ODD)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL_ROWS", 30)
    monkeypatch.setattr(knn, "CHUNK_ROWS", 40)
    monkeypatch.setattr(knn, "QUERY_ROWS", 4)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(scale=0.1, size=8)).tolist(), 0, 1) for i in range(500)]
    rows += [(1000 + i, rows[0][1], 0, 1) for i in range(250)]  # one vector many times
    rows += [(2000, None, 0, 1), (2050, [None] * 8, 0, 1), (2100, [float("nan")] * 8, 0, 1), (2150, [1.0, 2.0], 0, 1)]
    rows += [(None, rows[1][1], 0, 1), (2201, [1.5, -2.0], 0, 1), (2250, [float("inf")] * 8, 0, 1), (2300, [], 0, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, cell int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in knn.top_k(table).collect()}
    good = {i: np.floor(256 * np.array(v)).astype(int) for i, v, _, _ in rows if i is not None and i < 2000}
    good |= {2150: np.array([256, 512]), 2201: np.array([384, -512]), 2300: np.array([], int)}
    want = {}
    for q in good:
        if q % 50 == 0:
            best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
            want |= {(q, n): (i, -s) for n, (s, i) in enumerate(best, 1)}
    assert got == want
    assert knn.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_mixing(spark):
    docs = documents(spark).unionByName(odd_docs(spark).select(documents(spark).columns))
    rows = mixing.mixed(docs).collect()
    sizes = collections.defaultdict(int)
    for r in docs.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = dict(zip(names, [3, 1, 2] * len(names)))
    free, left, target = set(names), 1.5 * sum(sizes.values()), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        for s in full or free:
            target[s] = 2.0 * sizes[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        free = free - full if full else set()
    taken = collections.defaultdict(int)
    largest = collections.defaultdict(int)
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert len(rows) == docs.count() and all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in names)
    again = mixing.mixed(docs.repartition(7)).collect()
    assert collections.Counter(map(tuple, rows)) == collections.Counter(map(tuple, again))
    assert mixing.mixed(no_docs(spark)).count() == 0
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in rows)


def test_mixing_uses_no_python(spark):
    plan = mixing.mixed(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_url_parts_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/En/x?y#z", "https://www.example.com/en/1", "x://h#a/b",
            "http://example.com", "http://example.com/en/2?q", "http://notexample.com/en/", "http://b.net/es/1",
            "http://c.org/x://y/z"]
    pages = spark.createDataFrame([(i, u, None, 1) for i, u in enumerate(urls)], "page_id long, url string, html string, host int")
    rules = queries.URL_RULES
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judged(pages, rules).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("a.example.com", "/En/x", "com/", "allow")
    assert got[5] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[6] == ("h", "", None, "allow") and got[7] == ("example.com", "", None, "allow")
    assert got[8] == ("example.com", "/en/2", "example.com/en/", "block")
    assert got[9][2:] == ("com/", "allow") and got[10][2:] == ("net/es/", "block") and got[11][:2] == ("c.org", "/x://y/z")
    assert urlfilter.judged(pages.limit(0), rules).count() == 0


def test_link_trust_like_brute_force(spark):
    rng = np.random.default_rng(8)
    hosts = [f"h{i}.com" if i < 5 else f"h{i}.net" if i < 10 else f"h{i}.org" for i in range(30)]
    pages = []
    for i in range(200):
        h = hosts[int(rng.integers(30))]
        to = rng.choice(hosts, 3)
        html = "".join(f'<a HREF="http://{t.upper()}/p">x</a>' for t in to) + '<a href="/local">y</a>'
        pages.append((i, f"http://{h}/" + ("es/" if h.endswith("net") else "en/") + str(i), html))
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    rules = (("allow", "com", "/"), ("block", "net", "/es/"))
    got = {r["host"]: (r["trust"], r["distrust"], r["verdict"]) for r in urlfilter.judged(table, rules).collect()}
    count = collections.Counter(u.split("/")[2] for _, u, _ in pages)
    links = collections.Counter()
    for _, u, html in pages:
        src = u.split("/")[2]
        for dst in set(re.findall(r"http://([^/]+)", html.lower())) - {src}:
            links[src, dst] += 1
    import math

    for kind, (suffix, edges) in enumerate(((".com", links), (".net", {(b, a): n for (a, b), n in links.items()}))):
        total = sum(n for h, n in count.items() if h.endswith(suffix))
        seed = {h: math.floor(n * 1e12 / total) for h, n in count.items() if h.endswith(suffix)}
        out = collections.Counter()
        for (a, _), n in edges.items():
            out[a] += n
        mass = dict(seed)
        for _ in range(urlfilter.ROUNDS):
            new = collections.Counter({h: math.floor(s * (1 - urlfilter.DAMPING)) for h, s in seed.items()})
            for (a, b), n in edges.items():
                if a in mass:
                    new[b] += math.floor(mass[a] * (n / out[a] * urlfilter.DAMPING))
            mass = new
        for h in got:
            assert got[h][kind] == mass.get(h, 0)
    assert {v for h, (_, _, v) in got.items() if h.endswith("org")} <= {"allow", "block"}


def test_licenses(spark):
    texts = [
        licenses.MIT, licenses.MIT.replace("\n", "  ").upper(), "Copyright (c) 2020 Someone\n\n" + licenses.MIT,
        licenses.MIT + " more", None, "", "x\nReleased under the MIT licence", "LICENCED under the apache license - version 2.0",
    ]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, line int")
    got = {r["doc_id"]: (r["whole_license"], r["license_lines"], r["licenses"]) for r in licenses.scanned(docs).collect()}
    assert [got[i][0] for i in range(6)] == ["MIT", "MIT", "MIT", None, None, None]
    assert got[6] == (None, 1, "MIT") and got[7][0] == "Apache-2.0" and got[5] == (None, 0, "")
    assert licenses.scanned(odd_docs(spark)).count() == len(ODD) and licenses.scanned(no_docs(spark)).count() == 0


def test_quality_on_labels(spark):
    sf = SMALL.replace("0.001", "0.01")
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    rows = quality.classified(docs).join(labels, "doc_id").select("keep", "quality").collect()
    good = [r["keep"] for r in rows if r["quality"] == 1]
    bad = [r["keep"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.05
    # thousands of copies of one text do not crowd the others out of the sample
    copies = spark.range(3 * docs.count()).select(
        (-F.col("id") - 1).alias("doc_id"), F.lit("A clean sentence of plain words, over and over.").alias("text")
    )
    mixed = docs.select("doc_id", "text").unionByName(copies)
    fitted = quality.fit(mixed, 2000)
    again = quality.classified(mixed, model=fitted).join(labels.where("quality = 0"), "doc_id").agg(F.avg(F.col("keep").cast("int")))
    assert again.first()[0] < 0.5
    rows = quality.sample_rows(mixed.select("text", F.xxhash64("doc_id", "text").alias("h")), 2000)
    assert len(rows) == min(2000, mixed.count()) and rows["pattern"].nunique() > 1
    odd = quality.classified(odd_docs(spark)).collect()
    assert len(odd) == len(ODD) and quality.classified(no_docs(spark)).count() == 0
    kept = quality.keep_good(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and kept.count() == sum(r["keep"] for r in odd)


def test_rollups(spark):
    root = run_folder(spark, "test-rollup")
    schema = "op string, doc_id long, source string, lang string, version string, n_tokens long"

    def commit(batch, *rows):
        rollups.commit(spark, root, batch, spark.createDataFrame(list(rows), schema))

    def now():
        return {tuple(r)[:3]: tuple(r)[3:] for r in rollups.totals(spark, root).collect()}

    assert now() == {}
    commit(1, ("insert", 1, "a", "en", "v", 10), ("insert", 2, "a", "en", "v", 5), ("insert", 3, None, None, "v", None),
           ("insert", None, "a", "en", "v", 99), ("wrong", 9, "a", "en", "v", 99))
    assert now() == {("a", "en", "v"): (2, 15), (None, None, "v"): (1, 0)}
    second = [("revise", 1, "b", "en", "v", 7), ("delete", 2, None, None, "v", None), ("delete", 8, None, None, "v", None)]
    commit(2, *second)
    after = {("b", "en", "v"): (1, 7), (None, None, "v"): (1, 0)}
    assert now() == after
    commit(2, *second)
    assert now() == after
    commit(3, ("insert", 2, "a", "de", "v", 4), ("insert", 2, "a", "de", "w", 4), ("delete", 1, None, None, "v", None))
    commit(2, *second)  # an old batch again, after later ones
    commit(4)
    assert now() == {("a", "de", "v"): (1, 4), ("a", "de", "w"): (1, 4), (None, None, "v"): (1, 0)}


def test_corpus_rollup_like_brute_force(spark):
    docs = documents(spark)
    got = {tuple(r)[:2]: tuple(r)[3:] for r in rollups.corpus_rollup(docs, tokens.default_path(), "t").collect()}
    want, seen = collections.defaultdict(lambda: [0, 0]), set()
    for r in docs.orderBy("doc_id").collect():
        if r["text"] not in seen:
            seen.add(r["text"])
            cell = want[r["source"], r["lang"]]
            cell[0] += 1
            cell[1] += len(tokens.encoder(tokens.default_path()).encode([r["text"]])[0])
    assert got == {k: tuple(v) for k, v in want.items()}
    assert rollups.corpus_rollup(no_docs(spark), tokens.default_path(), "t").count() == 0
    rollups.corpus_rollup(odd_docs(spark), tokens.default_path(), "t").collect()


def test_licenses_in_longer_documents(spark):
    whole = dict(licenses._files()[::2])
    commented = "".join(f" * {line}\n" for line in licenses.APACHE_HEADER.format("https").splitlines())
    gpl = licenses.GNU_HEADER.format(":", "General Public License", ",", "either ", "3", ", or\n# (at your option) any later version")
    bsd = licenses.BSD_START.format("1. ", "2. ") + licenses.BSD_END.format("COPYRIGHT OWNER", "COPYRIGHT OWNER")
    texts = [
        (whole["Apache-2.0"], "Apache-2.0"), ("intro\n\n" + whole["GPL-2.0"] + "\nend", "GPL-2.0"),
        ("/*\n" + commented + " */\nint x;", "Apache-2.0"), ("# This program " + gpl + ".\nx = 1", "GPL-3.0"),
        ("intro\n" + licenses.MIT.replace(" ", "\n", 30) + "\noutro", "MIT"), ("Copyright (c) 2020 A\n\n" + bsd, "BSD-2-Clause"),
        ("a\n\nLicensed under the\nApache License, Version 2.0.\n\nb", "Apache-2.0"),
        ("x\nSPDX-License-Identifier: LGPL-2.1-or-later\ny", "LGPL-2.1"), ("a license, a permission", ""),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["whole_license"], r["licenses"]) for r in licenses.scanned(docs).collect()}
    assert [got[i][1] for i in range(len(texts))] == [want for _, want in texts]
    assert got[0][0] == "Apache-2.0" and got[1][0] is None
    assert {k for k, _ in licenses._files()} == set(licenses.BODIES)


def test_rollup_counts_every_row(spark):
    docs = documents(spark)
    again = docs.where("doc_id < 20")
    other = again.withColumn("text", F.lit("another text under the same id"))
    no_id = again.withColumn("doc_id", F.lit(None).cast("long"))
    rows = docs.unionByName(again).unionByName(other).unionByName(no_id)
    got = {tuple(r)[:2]: tuple(r)[3:] for r in rollups.corpus_rollup(rows, tokens.default_path(), "t", restore=True).collect()}
    want = collections.defaultdict(lambda: [0, 0])
    for r in rows.collect():
        cell = want[r["source"], r["lang"]]
        cell[0] += 1
        cell[1] += len(tokens.encoder(tokens.default_path()).encode([r["text"]])[0])
    assert got == {k: tuple(v) for k, v in want.items()}


def test_pipeline_like_brute_force(spark):
    docs = documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_filter"](spark, docs, SMALL)
    keep = {r["doc_id"] for r in quality.classified(docs).where("keep").collect()}
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == keep
    one = stages["near_dedup"](spark, good, SMALL)
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    parts = brute_components(rows, 5, 80)
    assert one.columns == docs.columns
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(d for d, (_, c) in parts.items() if c == d)
    mix = stages["mix_sources"](spark, one, SMALL)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed(one).collect() if r["copies"]}
    assert mix.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in mix.collect()) == collections.Counter(copies)
    packed = corpus_pipeline.run(spark, SMALL).collect()
    check_packing(packed, [(r["doc_id"], r["text"]) for r in mix.collect()])


def test_nothing_else_imports_the_package():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent
    users = [p for p in (root / "veilgrain").rglob("*.py") if "llm" not in p.parts and "veilgrain.llm" in p.read_text()]
    assert users == [] and "veilgrain.llm" in sys.modules


def test_quality_keeps_rows_with_odd_column_names(spark):
    kinds = "doc_id long, text string, `a.b` int, pattern string, features int, `row` int, h int"
    rows = [(i, "Plain words make a clean sentence of the usual kind, and nothing more.", 1, "p", 2, 3, i) for i in range(3)]
    rows += [(10 + i, None, 1, "p", 2, 3, i) for i in range(6)]
    docs = spark.createDataFrame(rows, kinds)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 9  # silent documents are not junk


def test_top_k_keeps_rows_that_share_an_id(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1, 4)]) for i in rng.integers(0, 130, 200)]
    rows += [(50, rows[0][1]), (50, rows[0][1]), (1, rows[0][1]), (1, rows[0][1]), (1, rows[1][1]), (None, rows[0][1])]
    got = collections.Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None]
    want = collections.Counter()
    for n, (i, q) in enumerate(kept):
        if i % 50 == 0:
            near = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(kept) if m != n)[:5]
            want.update((i, place, j, -s) for place, (s, j) in enumerate(near, 1))
    assert got == want
