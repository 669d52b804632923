"""Operators 11 to 13 against brute force, exact round trips, and rows that could trip them."""

import base64
import hashlib
import io
import json
import random
import re
import zipfile
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brakta.llm import clustering, registry, spelling, warc, wavelet, ziprange
from brakta.sources.files import store


def plain_variants(rows, least=7, often=2, every=31, ratio=10):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return plain_forms({w: n for w, n in counts.items() if n >= often}, ratio)


def plain_forms(words, ratio=10):
    near, gaps = defaultdict(set), defaultdict(set)
    for w in words:
        for p in range(len(w)):
            gaps[w[:p] + "\0" + w[p + 1 :]].add(w)
            shorter = w[:p] + w[p + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def test_wavelet_tree_reports_what_lies_in_a_rectangle():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 64, 65, 200):
        values = rng.permutation(n)
        tree = wavelet.WaveletTree(values)
        low, bottom = rng.integers(0, n, 100), rng.integers(0, n, 100)
        high, top = np.minimum(n, low + rng.integers(0, n + 1, 100)), np.minimum(n, bottom + rng.integers(0, n + 1, 100))
        got = defaultdict(set)
        for which, value in zip(*(x.tolist() for x in tree.report(low, high, bottom, top)), strict=True):
            assert value not in got[which]
            got[which].add(value)
        for i in range(100):
            assert got[i] == {v for v in values[low[i] : high[i]].tolist() if bottom[i] <= v < top[i]}


def test_near_pairs_of_every_window_are_the_plain_ones():
    rng = random.Random(4)
    for size in (1, 2, 5, 8):
        words = sorted({"".join(rng.choice("abé") for _ in range(rng.choice((size, size + 1)))) for _ in range(120)})
        got = Counter()
        cuts = sorted({0, size + 1, *(rng.randrange(1, size + 1) for _ in range(3))})
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            for a, b in zip(*spelling.near_pairs(words, size, lo, hi), strict=True):
                got[words[a], words[b]] += 1
        want = set()
        for a in words:
            for b in words:
                if len(a) == size and len(b) == size and sum(x != y for x, y in zip(a, b, strict=True)) == 1:
                    want.add((a, b))
                if len(a) == size and len(b) == size + 1 and any(b[:p] + b[p + 1 :] == a for p in range(size + 1)):
                    want.add((a, b))
        assert set(got) == want and set(got.values()) <= {1}


def test_spelling_variants_of_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {tuple(r) for r in registry.op11_spelling_variants(spark, data).collect()}
    assert got == plain_variants([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert any(r[1] for r in got) and any(r[4] > 3 for r in got)


def test_spelling_variants_of_odd_rows(spark):
    long = "Xylophoneß" * 3000
    texts = ["", None, " \n", "abcdefg " * 400, "abcdefx abcdefx ABCDEFG Àbcdefg Àbcdefg abcdefgh abcdefgh", f"{long} {long[:-1]}y", f"{long} {long[:-1]}y", "abcdefxh abcdefxh abcde 1234567", "×÷×÷×÷× " * 2, "日本語日本語日本 İstanbul İstanbul"]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(None, "abcdefq", "x", "y")] * 3 + [(77, "abcdefg", "x", "y")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n string")
    assert {tuple(r) for r in spelling.spelling_variants(df).collect()} == plain_variants([r[:2] for r in rows])
    none = spelling.spelling_variants(df.limit(0))
    assert none.collect() == [] and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_frequent_halves_are_cut_and_lose_nothing(spark):
    rng = random.Random(9)
    words = {"prefixes" + "".join(rng.choice("abc") for _ in range(6)): rng.randrange(2, 400) for _ in range(500)}
    words |= {"".join(rng.choice("abc") for _ in range(6)) + "suffixes": rng.randrange(2, 400) for _ in range(300)}
    words |= {"prefixes" + "".join(rng.choice("abc") for _ in range(5)): 4000 for _ in range(60)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    cut = spelling.dealt(df, hot=20)
    assert cut.filter("hi - lo > 1").groupBy("key").count().agg(F.max("count")).first()[0] <= 20
    want = plain_forms(words)
    assert any(w[1] and w[2] != w[1] for w in want) or any(w[1] for w in want)
    for hot in (20, spelling.HOT):
        assert {tuple(r) for r in spelling.variants(df, hot=hot).collect()} == want


def test_roots_follow_forms_to_the_last(spark):
    chain = {"aaaaaaaa": 2, "aaaaaaab": 20, "aaaaaabb": 200, "aaaaabbb": 2000, "aaaabbbb": 20_000, "aaabbbbb": 200_000}
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(list(chain.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"aaabbbbb"}


# --- 12


class Held:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, nbytes, offset):
        return self.data[offset : offset + nbytes]


def zipped(parts, prefix=b"", comment=b"", method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    out.write(prefix)
    with zipfile.ZipFile(out, "a" if prefix else "w", method) as z:
        z.comment = comment
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


@pytest.mark.parametrize("limit", [None, 10])
@pytest.mark.parametrize("prefix", [b"", b"#!/bin/sh\n"])
def test_directories_with_and_without_zip64(monkeypatch, limit, prefix):
    parts = {f"archive/däta-{i}.warc": bytes(random.Random(i).randbytes(50 * i)) for i in range(30)} | {"indexes/index.cdx": b"PK\5\6 in it", "a": b""}
    if limit:  # the standard library then writes 64-bit records for small files
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", limit)
    data = zipped(parts, prefix, comment=b"a comment with PK\5\6 in it, and more than twenty-two bytes")
    assert (b"PK\6\6" in data) == bool(limit)
    f = Held(data)
    found = ziprange.members(f)
    assert [m.name for m in found] == list(parts)
    for m in found:
        assert m.stored and m.size == len(parts[m.name]) == m.packed
        assert f.read_at(m.size, ziprange.start(f, m)) == parts[m.name]
    for broken in (b"", b"no archive", data[:-80]):
        with pytest.raises(ValueError):
            ziprange.members(Held(broken))
    assert not ziprange.members(Held(zipped({"x": b"y" * 100}, method=zipfile.ZIP_DEFLATED)))[0].stored


PAGES = "page_id long, url string, html string"
ODD = [(1, "http://a/", "same"), (2, "http://b/\r\nWARC-Type: x", "same"), (9, None, "same"), (3, "http://c/?q=é 日", None), (4, "", ""), (5, "u", "löng \r\n\r\n WARC/1.1 " * 30_000), (None, "n", "same"), (None, None, "alone"), (7, "r", "twice"), (7, "r", "twice"), (6, "r", "twice"), (8, "x", " same")]


def plain_pages(rows, least=0):
    last = {}
    for i, _, html in rows:
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        keeper = last.get(html or "") if len(data) >= least else None
        revisit = keeper is not None and i != keeper
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_archives_come_back_as_they_were_written(spark, least):
    df = spark.createDataFrame(ODD, PAGES).withColumn("payload", F.lit("clash")).withColumn("same", F.lit(1)).withColumn("m", F.lit(1))
    manifest = warc.write(df, least, size=2000)
    assert manifest.agg(F.sum("records")).first()[0] == len(ODD)
    back = warc.read(spark, manifest, payloads=True)
    rows = back.collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr) == plain_pages(ODD, least)
    assert all(r.intact for r in rows)
    text = {(i, html or "") for i, _, html in ODD}
    assert all((r.page_id, r.payload.decode()) in text for r in rows if r.record_type == "response")
    assert {r.url for r in rows} == {"http://a/", "http://b/%0D%0AWARC-Type:%20x", None, "http://c/?q=é%20日", "", "u", "n", "r", "x"}


def test_other_readers_read_the_archives(spark):
    manifest = warc.write(spark.createDataFrame(ODD, PAGES).repartition(1), size=1 << 30)
    uri = manifest.first().uri
    where, path = store(uri)
    with where.open_input_file(path) as f, zipfile.ZipFile(f) as z:
        assert z.testzip() is None
        data, lines = z.read(warc.WARC), [json.loads(x) for x in z.read(warc.INDEX).splitlines()]
    records = []
    while data:  # a member of gzip each, one after the other
        d = zlib.decompressobj(31)
        records.append(d.decompress(data) + d.flush())
        data = d.unused_data
    assert len(records) == len(lines) == manifest.first().records
    assert all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)


def test_broken_payloads_are_told(spark, tmp_path):
    archive = warc.Archive(f"file://{tmp_path}/x.wacz")
    good = warc.record(1, "u", "2024-01-01T00:00:00Z", b"payload", 7, warc.base32(hashlib.sha1(b"payload").digest()), None)
    for data in (good, good.replace(b"\r\n\r\npayload", b"\r\n\r\npaYload")):
        archive.add(data)
    uri, n, size = archive.close()
    rows = warc.read(spark, spark.createDataFrame([(uri, n, size)], "uri string, records long, bytes long")).collect()
    assert [r.intact for r in rows] == [True, False]


def test_pages_same_as_sql_and_no_pages(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    assert sorted(map(tuple, registry.op12_warc(spark, data).collect())) == sorted(con.sql(registry.SQL["op12_warc"]).fetchall())
    assert warc.archived(spark.createDataFrame([], PAGES)).collect() == []


# --- 13


def plain_clusters(rows, k, rounds, dim, scale=256, salt="2:"):
    def whole(x):
        from fractions import Fraction
        from math import floor

        return floor(Fraction(x) * scale)

    kept = [(i, [whole(x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{salt}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in start]

    def assign():
        out = []
        for _, v in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)))
        return out

    for _ in range(rounds):
        groups = defaultdict(list)
        for (_, j), (_, v) in zip(assign(), kept, strict=True):
            groups[j].append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    last, most = assign(), 2**63 - 1
    inertia = Counter()
    for d, j in last:
        inertia[j] += d
    return sorted(((i, j, min(most, d), min(most, inertia[j]), min(most, sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (d, j), (i, _) in zip(last, kept, strict=True)), key=repr)


def test_clusters_same_as_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    want = con.sql(registry.SQL["op13_centroid_clustering"])
    got = registry.op13_centroid_clustering(spark, data)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_partial_distances_end_at_the_nearest():
    rng = np.random.default_rng(8)
    for kind in (np.int64, object):
        x, c = rng.integers(-30, 30, (200, 64)).astype(kind), rng.integers(-30, 30, (17, 64)).astype(kind)
        c[5] = c[3]  # ties
        x[:20] = c[3]
        number, distance = clustering.nearest(x, c, rng.permutation(64))
        full = ((x[:, None].astype(np.int64) - c[None].astype(np.int64)) ** 2).sum(-1)
        assert number.tolist() == full.argmin(1).tolist() and distance.tolist() == full.min(1).tolist()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters_of_odd_rows(spark, kind):
    rng = random.Random(6)
    vec = lambda s=1.0: [float(np.float32(rng.gauss(0, s))) for _ in range(64)]
    huge = 3e38 if kind == "float" else 1e308
    rows = [(i, vec()) for i in range(60)] + [(5, vec()), (5, vec()), (None, vec())] + [(i, [0.25] * 64) for i in range(100, 130)]
    rows += [(200, [huge] + [0.0] * 63), (201, [-float(np.float32(1e30))] * 64), (202, [600_000.0] * 64), (203, [524_288.0] * 64)]
    odd = [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [None] + [1.0] * 63), (305, [float("nan")] + [1.0] * 63), (306, [float("inf")] + [1.0] * 63)]
    if kind == "float":
        rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows + odd, f"vec_id long, embedding array<{kind}>").withColumn("cluster", F.lit("clash")).withColumn("vec", F.lit("clash")).repartition(4)
    for k, rounds in ((7, 3), (200, 1)):
        got = sorted(map(tuple, clustering.cluster(df, k, rounds).collect()), key=repr)
        assert got == plain_clusters(rows, k, rounds, 64)


def test_no_vectors_no_clusters(spark):
    got = clustering.cluster(spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<double>"))
    assert got.collect() == [] and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
