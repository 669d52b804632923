"""Each operator against brute force on small fixtures, and on rows that could trip it."""

import hashlib
import math
import os
import random
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from brakta.llm import bpe, components, embed_dedup, langid, mixing, ngram_join, packing, quality, registry, suffix_dedup, token_count, topk, toxicity
from brakta.llm.common import hashed_sample, id_crc, labelled_sample

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000
ODD = [
    (1, None, None, None, None), (2, "", "en", "b", 0), (3, " \n\t ", "en", "b", 4), (4, "123 !!", "de", "a", 6), (5, LONG, "en", "a", len(LONG)), (6, "same text of seven words for you", "en", "a", 1), (7, "same text of seven words for you", "en", None, 1),
    (8, "same text of seven words for you", None, "b", 1), (8, "same text of seven words for you", None, "b", 1), (9, "one two", "es", "c", 7), (10, "one two", "es", "c", 7), (None, "no id here at all but words", "fr", "c", 2), (11, "x\x1cy   İß 日本 😀 <|endoftext|> don't", "fr", "c", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows, with further columns that operators use as names of their own."""
    df = spark.createDataFrame(ODD, DOCS)
    for c in ("label", "vec", "rep", "root", "part", "data", "size", "row", "spans", "score", "copies", "sig"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


# --- 1 packing, 5 token counts


def test_chunk_ids_are_the_library_s(docs):
    lib, encode = Tokenizer.from_file(TOKENIZER), bpe.encoder(TOKENIZER)
    count = token_count.counter(TOKENIZER, token_count.proven_singles(TOKENIZER))
    rng = random.Random(5)
    texts = [r.text for r in docs.collect()] + [t for _, t, *_ in ODD if t and t != LONG]
    texts += ["".join(chr(rng.choice((rng.randrange(1, 128), rng.randrange(1, 0x250), rng.randrange(1, 0x3000), 32, 39, 0x10400))) for _ in range(40)) for _ in range(300)]
    for t in texts:
        want = lib.encode(t, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(want)}I", encode(t))) == want, t
        assert count(t) == len(want)


def test_proven_singles_are_one_token():
    lib = Tokenizer.from_file(TOKENIZER)
    words = token_count.proven_singles(TOKENIZER)
    assert len(words) > 10_000
    assert all(len(e.ids) == 1 for e in lib.encode_batch(words[::50], add_special_tokens=False))


def test_token_counts_of_odd_rows(odd, none):
    rows = token_count.count_tokens(odd, TOKENIZER, limit=5).collect()
    assert len(rows) == len(ODD)
    lib = Tokenizer.from_file(TOKENIZER)
    want = Counter((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ODD)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 5) for r in rows)
    assert token_count.count_tokens(none, TOKENIZER).count() == 0


def test_other_vocabularies_go_through_their_library(odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = token_count.count_tokens(odd.filter("doc_id in (6, 9, 11)"), path).collect()
    texts = {i: t for i, t, *_ in ODD}
    assert all(r.n_tokens == len(sp.encode(texts[r.doc_id])) for r in rows)


def test_best_fit_decreasing_is_the_plain_one():
    rng = random.Random(1)
    for _ in range(20):
        lengths = sorted((rng.randrange(1, 64) for _ in range(rng.randrange(80))), reverse=True)
        bins, offsets = packing.best_fit_decreasing(lengths, 64)
        room, want = [], []
        for n in lengths:
            fits = [(r, i) for i, r in enumerate(room) if r >= n]
            least = min((r for r, _ in fits), default=None)
            if least is None:
                room.append(64 - n)
            else:
                room[next(i for r, i in fits if r == least)] -= n
            want.append(least)
        used = defaultdict(int)
        for n, b, o in zip(lengths, bins, offsets, strict=True):
            assert used[b] == o
            used[b] += n
        assert sorted(64 - x for x in used.values()) == sorted(room)


def check_packing(rows, texts, window):
    lib = Tokenizer.from_file(TOKENIZER)
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for doc, values in texts.items():
        want = Counter()
        for t in values:
            ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
            for s in range(0, len(ids), window):
                part = ids[s : s + window]
                want[s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(ids)] += 1
        assert Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces.pop(doc)) == want
    assert not pieces
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= window
    return sum(window - sum(n for _, n in p) for p in used.values()) / max(1, window * len(used))


def test_packing_round_trip(docs, odd, none):
    for df in (docs, odd):
        texts = defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            texts[r.doc_id].append(r.text)
        waste = check_packing(packing.pack_documents(df, TOKENIZER, 512).collect(), texts, 512)
    assert waste < 0.2
    assert check_packing(packing.pack_documents(docs, TOKENIZER).collect(), {r.doc_id: [r.text] for r in docs.collect()}, 4096) < 0.03
    assert packing.pack_documents(none, TOKENIZER).count() == 0


# --- 2 suffix-array dedup


def brute_repeats(rows, width):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - width + 1):
            w = data[s : s + width]
            if w in seen:
                gone[s : s + width] = True
            seen.add(w)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[doc] = (len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def repeat_rows(seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("ab é") for _ in range(rng.randrange(80, 240))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [rng.choice(passages)[rng.randrange(40) :] if rng.random() < 0.6 else "".join(rng.choice("abc\n") for _ in range(rng.randrange(60))) for _ in range(rng.randrange(6))]
        rows.append((i, "".join(parts)))
    return [*rows, (500, None), (501, ""), (502, "a" * 4000), (503, "ab" * 600), (504, "a" * 100), (505, "a" * 99), (506, "a" * 101)]


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_IN_BATCH, 2])
def test_repeats_equal_brute_force(spark, hot):
    rows = repeat_rows(hot)
    got = suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string"), hot_in_batch=hot).collect()
    want = brute_repeats(rows, 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert sum(v[1] for v in want.values()) > 10_000


def test_slices_of_long_texts_meet():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 3 * suffix_dedup.SLICE // 2, dtype=np.uint8).tobytes()
    _, first, n = suffix_dedup.contexts_of(data, 100)
    assert np.concatenate([np.arange(f, f + k) for f, k in zip(first, n, strict=True)]).tolist() == list(range(len(data) - 99))


def test_two_stage_order_is_the_sorted_one():
    rng = np.random.default_rng(1)
    for width in (8, 12):
        text = rng.integers(97, 99, 400, dtype=np.uint8)
        wanted = rng.random(400) < 0.8
        wanted[400 - width + 1 :] = False
        order = suffix_dedup.suffix_array(text, wanted, width)
        keys = [text[i : i + width].tobytes() for i in order]
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
        assert keys == sorted(keys)
        assert suffix_dedup.same_prefix(text, order, width).tolist() == [False, *(a == b for a, b in zip(keys, keys[1:], strict=False))]


def test_rows_of_one_id_are_documents_of_their_own(spark):
    """Ids that are negative, null or repeated: as a brute force over rows in the order of (id, hash of the text), equal rows once."""
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    make = lambda: " ".join(rng.choice(words) for _ in range(40))
    rows = [(i, make() + (passage if rng.random() < 0.6 else "") + make()) for i in (-1, -1, -7, 3, 3, 3, None, None, None, 8)]
    rows += [rows[0], rows[0], rows[6], (None, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kinds = {(r.doc_id, r.text): r.v for r in df.withColumn("v", F.xxhash64("text")).collect()}
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, kinds[r]))
    want = brute_repeats([(n, r[1]) for n, r in enumerate(order)], 100)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.digest(df).collect()), key=repr)
    assert got == sorted(((r[0], *want[order.index(r)]) for r in rows), key=repr)
    assert sum(n[1] > 0 for n in want.values()) >= 3


def test_anchors_with_many_contexts_in_all(spark):
    """Dealt by window because of their number over all batches: the same result."""
    rows = repeat_rows(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_repeats(rows, 100)
    for r in suffix_dedup.digest(df, many_contexts=1).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]


def test_repeats_of_odd_rows(odd, none):
    rows = suffix_dedup.digest(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_bytes == by[1].n_removed == 0 and by[6].n_removed == 0
    assert by[5].n_removed > 100_000 and by[5].n_spans == 1
    assert suffix_dedup.digest(none).count() == 0


def test_cut_texts_keep_their_columns(odd):
    out = suffix_dedup.remove_repeats(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert {r.doc_id: r.text for r in out.collect()}[1] is None


# --- 3 language identification


def test_languages_are_found(spark):
    words = {"en": "the and of that with from this have", "de": "der und die das mit von nicht eine", "fr": "le et les des avec pour dans une"}
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(words[k].split()) for _ in range(60)), k) for i, k in enumerate([*words] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = F.pmod(id_crc(), F.lit(5)) == 0
    got = langid.identify(df, langid.learn(df.filter(~out)), out).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_dictionaries_hold_words_from_all_over_the_texts(spark):
    """1,200 texts, each with words of its own at every place: the dictionary holds some from every tenth of the length."""
    rows = [(i, " ".join(f"t{k // 30}x{i}w{k}" for k in range(300)), "xx") for i in range(1200)]
    made = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["xx"].decode()
    tenths = Counter(w[1] for w in made.split() if w[0] == "t" and w[1:2].isdigit())
    assert len(made.encode()) <= 110_000 and len(made) > 60_000
    assert min(tenths[str(t)] for t in range(10)) > 0.3 * max(tenths.values())


def test_rare_languages_and_repeated_rows_are_learned(spark):
    rows = [(i, f"the common words of text number {i}", "en") for i in range(5000)] + [(9001, "ovo je rijetko", "hr")] + [(9002, "samma ord om igen", "sv")] * 3000
    learned = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(learned) == ["en", "hr", "sv"] and learned["sv"] == b"samma ord om igen"


def test_sizes_equal_a_plain_coder_s(docs):
    """Every prediction against one compressor made anew for each block and language; ties go to the more frequent language."""
    learned = langid.learn(docs) | {"zz": b""}
    learned["ab"] = learned["en"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    for r in langid.identify(docs.withColumn("block", F.lit(1)), learned, F.lit(False)).collect():
        data = rows[r.doc_id].lower().encode()
        sizes = {}
        for name, raw in learned.items():
            known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            plain = lambda b: zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False).compress(b)  # noqa: B023, E731
            sizes[name] = sum(len(plain(data[i : i + 2048])) for i in range(0, len(data), 2048))
        assert r.lang_pred == min(sizes, key=sizes.get) != "ab"


def test_language_of_odd_rows(odd, none):
    learned = langid.learn(odd)
    rows = langid.identify(odd, learned, F.lit(False)).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4
    assert all(r.lang_pred in learned for r in rows if r.doc_id not in (1, 2, 3, 4))
    assert {r.lang_pred for r in langid.identify(odd, langid.learn(none), F.lit(True)).collect()} == {"und"}
    assert langid.identify(none, learned, F.lit(True)).count() == 0


def test_narrow_margins_are_rejected(docs):
    learned = langid.learn(docs)
    share = [langid.identify(docs, learned, F.lit(False), margin=m).filter("rejected").count() for m in (0.0, 0.05, 0.5)]
    assert share[0] <= share[1] <= share[2]


# --- 4 mixing


def plain_targets(sizes, cycle=(3, 1, 2), share=1.5, cap=2.0):
    """Water filling by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    goal, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        rest, w = goal - sum(out.values()), sum(weight[s] for s in open_)
        full = [s for s in open_ if rest * weight[s] / w > cap * sizes[s]]
        if not full:
            return out | {s: rest * weight[s] / w for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            open_.discard(s)
    return out


def check_mix(rows, slack):
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
    want = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= slack(sizes[s])


def test_mix_meets_targets(docs):
    mixed = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    assert len(mixed) == docs.count()
    check_mix(mixed, lambda n: 0.05 * n + 60)
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in mixed}


def test_a_size_that_many_share_is_dealt_evenly(spark):
    rows = [(i, "w " * 10, "a") for i in range(3000)] + [(5000 + i, "w " * (1 + i % 40), "b" if i % 3 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df)
    check_mix(got.join(df.select("doc_id", "source"), "doc_id").collect(), lambda n: 0.01 * n + 10)


def test_longer_documents_are_tilted_down(spark):
    """Where words are to be left out, a document's rate is exp(lambda * size)."""
    rows = [(i, "w " * (10 * (1 + i % 9)), "b") for i in range(4000)] + [(9000 + i, "w " * 900, "a") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).filter("doc_id < 9000").groupBy("size").agg(F.avg("copies").alias("rate")).orderBy("size").collect()
    logs = np.log([r.rate for r in got])
    slope = np.polyfit([r["size"] for r in got], logs, 1)
    assert np.abs(np.polyval(slope, [r["size"] for r in got]) - logs).max() < 0.05


def test_tilts_are_those_of_a_plain_root_finder(spark):
    """Each source's tilt against bisection over its documents; many sources, one of them with a third of all rows."""
    rng = random.Random(21)
    rows = [(i, " ".join(["w"] * rng.choice((1, 2, 5, 30, 200))), "hub" if i % 3 == 0 else f"s{rng.randrange(90):02d}") for i in range(1500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    per = defaultdict(list)
    names = {i: s for i, _, s in rows}
    for r in got:
        per[names[r.doc_id]].append(r)
    want = plain_targets({s: sum(r.size for r in rs) for s, rs in per.items()})
    for s, rs in per.items():
        total, mean = sum(r.size for r in rs), sum(r.size for r in rs) / len(rs)
        assert math.isclose(rs[0].target, want[s], rel_tol=1e-9)
        if rs[0].target >= 2 * total * (1 - 1e-12):
            assert all(r.rate == 2 for r in rs)
            continue
        low, high = -200.0, 200.0
        for _ in range(200):
            tilt = (low + high) / 2
            value = sum(r.size * min(2.0, math.exp(min(1.0, tilt * r.size / mean))) for r in rs)
            low, high = (tilt, high) if value < rs[0].target else (low, tilt)
        assert all(math.isclose(r.rate, min(2.0, math.exp(min(1.0, tilt * r.size / mean))), rel_tol=1e-6) for r in rs)


def test_ids_that_very_many_rows_share_are_mixed_by_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", 10)
    rows = [(7 if i % 3 else None, "a b c d", "x" if i % 2 else None) for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 600 and all(r.taken == r.copies * r.size and r.copies <= 2 for r in got)
    taken = Counter()
    for r in got:
        taken[r.target] += r.taken
    assert sorted(taken.items()) == [(1200.0, 1200), (2400.0, 2400)]


def test_mix_of_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].size == by[2].size == by[3].size == 0 == by[1].taken
    assert by[4].size == 2 and by[5].size == 30_000
    assert mixing.mix(none).count() == 0


# --- 6 toxicity, 9 quality


def labelled(spark, n=900):
    """Insult and group together are toxic, either alone is not; capitals are poor."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice("abcdefghij") * rng.randrange(2, 5) for _ in range(30)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["scoundrel"] * insult + ["villagers"] * group
        rng.shuffle(words)
        good = rng.random() < 0.7
        text = " ".join(words) + "." if good else " ".join(words).upper() + "!!"
        rows.append((i, text))
        labels.append((i, int(good), int(insult and group)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(df, labels, column):
    rows = df.filter("held_out").join(labels, "doc_id").select("predicted", column).collect()
    return sum(r[0] == r[1] for r in rows) / len(rows)


def test_pairs_of_terms_are_learned(spark):
    df, labels = labelled(spark)
    out = F.pmod(id_crc(), F.lit(4)) == 2
    machine = toxicity.fit(df, labels.filter(~out))
    assert accuracy(toxicity.score(df, machine, out), labels, "toxic") > 0.9
    kept = toxicity.reject(df, machine)
    assert kept.columns == df.columns
    assert kept.join(labels, "doc_id").filter("toxic = 0").count() > 0.9 * labels.filter("toxic = 0").count()


def test_neighbours_vote_for_quality(spark):
    df, labels = labelled(spark)
    out = F.pmod(id_crc(), F.lit(4)) == 2
    voters = quality.fit(df, labels.filter(~out))
    assert accuracy(quality.score(df, voters, out, 0.5), labels, "quality") > 0.95


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_scores_of_odd_rows(spark, odd, none, module, label):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 11)] + [(11, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for learned in (module.fit(odd, labels), module.fit(none, labels), module.fit(odd, labels.filter(f"{label} = 1"))):
        rows = module.score(odd, learned, F.lit(False)).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in rows)
        assert module.score(none, learned, F.lit(False)).count() == 0


def test_labels_and_ids_are_no_inputs(spark):
    df, labels = labelled(spark, 200)
    machine = toxicity.fit(df, labels)
    a = {r.doc_id: r.score for r in toxicity.score(df, machine, F.lit(True)).collect()}
    moved = df.withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("lang", F.lit("xx"))
    assert a == {r.doc_id - 10_000: r.score for r in toxicity.score(moved, machine, F.lit(False)).collect()}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the tables at scale 0.01")
def test_few_toxic_rows_are_enough(spark):
    """At scale 0.01, with 37 toxic rows to learn from: better than the one most telling word, and no clean document lost."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = F.pmod(id_crc(), F.lit(4)) == 2
    scores = toxicity.score(docs, toxicity.fit(docs, labels.filter(~out)), out)
    rows = scores.join(labels.filter("toxic is not null"), "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    learned, held = ([r for r in rows if r.held_out == side] for side in (False, True))

    def words(r):
        return set(map(toxicity.bare, (r.text or "").split()))

    count = {y: Counter(w for r in learned if r.toxic == y for w in words(r)) for y in (0, 1)}
    best = max(sorted(count[1]), key=lambda w: math.log((count[1][w] + 0.5) / (count[0][w] + 0.5)))

    def auc(score):
        bad, good = ([score(r) for r in held if r.toxic == y] for y in (1, 0))
        return sum((b > g) + (b == g) / 2 for b in bad for g in good) / len(bad) / len(good)

    assert auc(lambda r: r.score) > max(0.75, auc(lambda r: best in words(r)))
    assert sum(r.predicted for r in held if r.toxic) >= 0.6 * sum(r.toxic for r in held)
    assert not any(r.predicted for r in held if not r.toxic)
    assert 0.001 < min(r.score for r in rows) and max(r.score for r in rows) < 0.999


def test_length_alone_moves_no_score_far(spark):
    """A text of a million words scores like its distinct words, and no score sits at the clip."""
    df, labels = labelled(spark)
    machine = toxicity.fit(df, labels)
    long = spark.createDataFrame([(1, "aa bb scoundrel villagers"), (2, "aa bb scoundrel villagers " * 250_000), (3, "aa bb " * 500_000), (4, "aa bb")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(long, machine, F.lit(False)).collect()}
    assert got[1] == got[2] > 0.5 > got[3] == got[4] > 1e-6


def test_machine_scores_are_the_sum_over_pairs(spark):
    """The score of every text against weights and products of factors summed pair by pair, for values of length 1 at most."""
    df, labels = labelled(spark)
    machine = toxicity.fit(df, labels)
    place = {int(k): i for i, k in enumerate(machine.keys)}
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in toxicity.score(df, machine, F.lit(False)).filter("doc_id % 17 = 0").collect():
        own = sorted({place[h] for c in texts[r.doc_id].split() for h in toxicity.chunk_hashes(c) if h in place})
        size = max(1, math.sqrt(sum(machine.values[i] ** 2 for i in own)))
        z = machine.bias + sum(machine.weights[i] for i in own) / size
        z += sum(float(machine.factors[i] @ machine.factors[j]) for n, i in enumerate(own) for j in own[n + 1 :]) / size**2
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9


def test_votes_are_those_of_the_nearest_rows(spark):
    """Scores against a plain sort of all cosines, ties by row; the same whatever the partitions."""
    df, labels = labelled(spark)
    more = lambda x: x.unionByName(x.filter("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 10_000))
    df = more(df)
    voters = quality.fit(df, more(labels))
    texts = {r.doc_id: r.text for r in df.collect()}
    got = {r.doc_id: r.score for r in quality.score(df, voters, F.lit(False)).collect()}
    assert got == {r.doc_id: r.score for r in quality.score(df.repartition(7), voters, F.lit(False)).collect()}
    get = quality.hasher()
    for doc in list(texts)[::29]:
        own = voters.embed(*quality.sparse([quality.weighted_terms(texts[doc], get, voters.form_weight)]), 1)[0]
        near = sorted(((-round(float(own @ v), 9), i) for i, v in enumerate(voters.vectors)))[: voters.neighbours]
        weight = [max(-c, 0) ** 8 for c, _ in near]
        want = sum(w * voters.labels[i] for w, (_, i) in zip(weight, near, strict=True)) / sum(weight)
        assert abs(got[doc] - want) < 1e-6


def test_form_weight_is_learned(spark):
    """Where form tells the label and words do not, it gets weight; where words do, none is taken that is worse."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(words).upper() if i % 2 else rng.choice(words) for _ in range(40)), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    assert quality.fit(df, df).form_weight > 0
    rows = [(i, " ".join(f"{'good' if i % 2 else 'poor'}{rng.randrange(12)}" for _ in range(40)), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    assert quality.fit(df, df).form_weight == 0


def test_labelled_samples_are_bounded_by_rows_and_bytes(spark):
    """One id with a third of all rows, its texts equal or not, and a text beyond the budget."""
    docs = spark.range(900).select(F.when(F.col("id") < 300, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 450).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(7, "x" * 5000)], "doc_id long, text string"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    got = labelled_sample(docs, labels, "toxic", 100, 500, "doc_id", "text").collect()
    assert 40 < len(got) <= 100 and sum(len(r.text) for r in got) <= 500
    assert sorted(got) == sorted(labelled_sample(docs.repartition(9), labels.repartition(5), "toxic", 100, 500, "doc_id", "text").collect())
    assert labelled_sample(docs, labels, "toxic", 5000, 1 << 20, "doc_id", "text").count() == docs.distinct().count()


def test_samples_are_bounded_and_the_same(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a, b = (sorted(r.k for r in hashed_sample(df.repartition(n), "k", 500).collect()) for n in (2, 5))
    assert a == b and 350 < len(a) < 650


# --- 7 n-gram join


def plain_links(rows, words=5, threshold=0.8):
    sets = {}
    for doc, text in rows:
        w = [x for x in (text or "").translate(ngram_join.BLANKS).split(" ") if x]
        sets[doc] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    links = defaultdict(set)
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    root = {}
    for a in ids:
        stack = [a]
        while stack:
            x = stack.pop()
            if x not in root:
                root[x] = root.get(a, a)
                stack += links[x]
    return {a: (root[a], len(links[a])) for a in ids}


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(30):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for k in range(rng.randrange(1, 8)):
            own = list(base)
            for _ in range(rng.randrange(4) if k else 0):
                own[rng.randrange(120)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = plain_links(rows)
    assert sum(n for _, n in want.values()) > 60
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_lone_pairs_are_found_beside_a_large_group(spark):
    """Pairs that share 80 (at the threshold) or 83 to 85 of 100 runs and link with nothing else, and 700 near copies of one text."""
    rng = random.Random(12)
    rows = []
    for pair in range(2500):
        shared = [f"p{pair}s{i}" for i in range(84 + pair % 2 * rng.randrange(3, 6))]
        ends = 104 - len(shared)
        for side in "ab":
            own = ends // 2 if side == "a" else ends - ends // 2
            rows.append((len(rows), " ".join([*shared, *(f"p{pair}{side}{i}" for i in range(own))])))
    lone = len(rows)
    base = [f"g{i}" for i in range(300)]
    for k in range(700):
        own = list(base)
        own[rng.randrange(300)] = f"n{k}"
        rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_join.near_duplicates(df).collect()}
    for band in (0, 1):
        pairs = [a for a in range(0, lone, 2) if a // 2 % 2 == band]
        assert all(got[a].n_links <= 1 for a in pairs)
        assert sum(got[a].n_links == 1 and got[a + 1].class_id == a for a in pairs) >= 0.99 * len(pairs)
    assert {got[i].class_id for i in range(lone, len(rows))} == {lone}


def test_large_groups_go_through_blocks(spark):
    """Blocks of a few rows give the same links as one group."""
    rng = random.Random(4)
    base = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:100], f"x{rng.randrange(1000)}", *base[100:]])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_links(rows)
    for r in ngram_join.near_duplicates(df, block=7).collect():
        assert (r.class_id, r.n_links) == want[r.doc_id]


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    t, u = (" ".join(f"{c}{i}" for i in range(60)) for c in "tu")
    rows = [(1, t), (1, u), (2, t + " more"), (3, u + " more"), (4, u), (4, u), (5, "nothing like the others at all"), (5, t + " end")]
    got = sorted((r.doc_id, r.class_id, r.n_links, r.kept) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 2, True), (1, 1, 3, True), (2, 1, 2, False), (3, 1, 3, False), (4, 1, 3, False), (4, 1, 3, False), (5, 1, 2, False), (5, 5, 0, True)]


def test_links_of_odd_rows(odd, none):
    rows = ngram_join.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].n_links == by[2].n_links == by[3].n_links == 0 and by[1].kept
    assert {(by[i].class_id, by[i].n_links) for i in (6, 7, 8)} == {(6, 3)}
    assert (by[10].class_id, by[10].n_links) == (9, 1)
    assert by[None].class_id is None and by[None].kept
    assert ngram_join.near_duplicates(none).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 301), (301, 300), (500, 500)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {301: 300}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_hubs_are_joined_as_other_keys(spark, monkeypatch):
    rng = random.Random(3)
    links = [(0, i) for i in range(1, 200)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    df = spark.createDataFrame(links, "a long, b long")
    want = {r.node: r.root for r in components.connected_components(df, "t").collect()}
    monkeypatch.setattr(components, "FEW", 2)
    assert {r.node: r.root for r in components.connected_components(df, "t").collect()} == want
    assert all(want[i] == 0 for i in range(1, 200))


# --- 8 embedding near-dedup, 10 top-k

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(seed=6, n=260, dim=24):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i and rng.random() < 0.5:
            v = np.array(rows[int(rng.integers(len(rows)))][1]) + rng.normal(0, 0.03, dim)
        else:
            v = rng.normal(size=dim)
        v /= np.linalg.norm(v)
        rows.append((i, v.astype(np.float32).tolist(), int(rng.integers(3))))
    return rows + [(1000 + i, rows[0][1], rows[0][2]) for i in range(5)]


BAD = [(2000, None, 1), (2001, [0.0] * 24, 1), (2002, [None] + [1.0] * 23, 1), (2003, [float("nan")] + [1.0] * 23, 1), (2004, [float("inf")] + [1.0] * 23, 1), (2005, [1.0] * 24, None), (2006, [1.0] * 5, 1), (2007, [1.0] * 5, 1), (2008, [], 1)]


def plain_vector_links(rows, threshold):
    ok = [(i, np.array(v, float), k) for i, v, k in rows if i is not None and k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = defaultdict(set)
    for i, a, k in ok:
        for j, b, m in ok:
            if i < j and k == m and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i, *_ in rows:
        seen, stack = set(), [i]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += links[x]
        out[i] = (len(links[i]), min(seen))
    return out


@pytest.mark.parametrize("block", [1024, 8])
def test_vector_links_have_high_recall(spark, block):
    rows = vectors() + BAD
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS), 0.93, block=block).collect()}
    want = plain_vector_links(rows, 0.93)
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values()) > 100
    assert all(got[i] == (0, i) for i in (2000, 2001, 2002, 2003, 2004, 2005, 2008))
    assert got[2006] == (1, 2006) and got[2007] == (1, 2006)
    assert got[1000][0] >= 5


def test_links_at_the_threshold_are_found_and_none_below_it(spark):
    """Thousands of pairs just over and just under 0.93, in vectors that are far apart otherwise: recall by links, and not one too many."""
    rng = np.random.default_rng(17)
    base = rng.normal(size=(3000, 64))
    over, under = ([embed_dedup.turned(base, c, seed) for c, seed in zip(cosines, seeds, strict=True)] for cosines, seeds in (((0.9301, 0.932, 0.94), (1, 2, 3)), ((0.9, 0.92, 0.9299), (4, 5, 6))))
    pick = np.arange(3000) % 3
    partner = np.where((np.arange(3000) % 2 == 0)[:, None], np.choose(pick[:, None], over), np.choose(pick[:, None], under))
    df = spark.createDataFrame([(i, v.tolist(), i % 3000 % 5) for i, v in enumerate(np.concatenate([base, partner]))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect()}
    found = sum(got[i] == (1, i) and got[3000 + i] == (1, i) for i in range(0, 3000, 2))
    assert found >= 0.99 * 1500
    assert all(got[i] == (0, i) and got[3000 + i] == (0, 3000 + i) for i in range(1, 3000, 2))


def test_tables_are_as_wide_as_the_vectors_are_many():
    """More vectors, longer substrings; enough tables for the recall that is measured; pairs at the threshold are within the radius."""
    sample = np.random.default_rng(2).normal(size=(600, 48))
    few, many = (embed_dedup.learn_tables(sample, n, 0.93) for n in (2000, 10_000_000))
    assert few.width == 8 and many.width > 10 and many.count > few.count
    fresh = np.random.default_rng(5).normal(size=(2000, 48))
    other = embed_dedup.turned(fresh, 0.93, 6)
    assert np.allclose((embed_dedup.unit(fresh) * other).sum(1), 0.93)
    for tables in (few, many):
        (k1, c1), (k2, c2) = (tables.codes(x) for x in (fresh, other))
        apart = np.unpackbits(c1 ^ c2, axis=1).sum(1)
        assert ((k1 == k2).any(1) & (apart <= tables.radius)).mean() > 0.97


def test_vectors_of_several_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(11)
    rows = []
    for n in (6, 16, 40):
        base = rng.normal(size=(40, n))
        rows += [(len(rows) + i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, base + rng.normal(0, 0.02, base.shape)]))]
    df = spark.createDataFrame(rows, VECTORS)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect()}
    want = plain_vector_links(rows, 0.93)
    assert got == want
    twice = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (None, [1.0, 0.0], 0)], VECTORS)
    found = sorted((r.vec_id or 0, r.component_id, r.n_links, r.kept) for r in embed_dedup.near_duplicates(twice).collect())
    assert found == [(0, None, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_no_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert embed_dedup.near_duplicates(empty).count() == 0
    assert topk.top_k(empty, empty).count() == 0
    only_bad = spark.createDataFrame([r for r in BAD if r[0] <= 2005], VECTORS).withColumn("rep", F.lit(1)).withColumn("links", F.lit(1))
    assert embed_dedup.near_duplicates(only_bad).count() == 6


@pytest.mark.parametrize("tile", [4096, 9])
def test_top_k_equals_brute_force(spark, tile):
    rows = vectors() + BAD
    df = spark.createDataFrame(rows, VECTORS).withColumn("id", F.lit("clash")).withColumn("r", F.lit(1))
    got = defaultdict(list)
    for r in topk.top_k(df.filter("vec_id % 20 = 0"), df, 5, candidate_tile=tile, query_tile=7).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ok = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v, _ in rows if v is not None and None not in v and np.isfinite(v).all()}
    for q in ok:
        if q % 20 == 0:
            scores = sorted((-int(ok[q] @ ok[c]), c) for c in ok if c != q and len(ok[c]) == len(ok[q]))
            assert sorted(got.pop(q, [])) == [(k + 1, c, -s) for k, (s, c) in enumerate(scores[:5])]
    assert not got


def test_top_k_with_huge_components_and_ties(spark):
    rows = [(0, [1e30, 1.0], 0), (1, [1e30, 1.0], 0), (2, [1e-3, 1.0], 0), (3, [1e-3, 1.0], 0), (4, [1e-3, 1.0], 0)]
    got = topk.top_k(spark.createDataFrame(rows[:1], VECTORS), spark.createDataFrame(rows, VECTORS), 3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3]


@pytest.mark.parametrize("tile", [None, 2])
def test_scores_beyond_a_long_are_ranked_exactly(spark, tile):
    """Products of any size rank by their value; the column ends at the bounds of a long. A repeated row is found as often as it is there."""
    big = [(0, [3e200, 1.0], 0), (1, [1e150, 0.0], 0), (2, [1e308, 0.0], 0), (3, [2e150, 0.0], 0), (4, [-1e200, 0.0], 0), (5, [-2e200, 0.0], 0), (6, [0.0, 7.0], 0), (3, [2e150, 0.0], 0)]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>, label int")
    got = topk.top_k(df.filter("vec_id = 0"), df, 7, candidate_tile=tile).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [2, 3, 3, 1, 6, 4, 5]
    assert [r.score for r in got] == [2**63 - 1] * 4 + [256 * 7 * 256] + [1 - 2**63] * 2


# --- queries


def test_queries_with_sql(spark, data):
    con = duckdb.connect()
    for table in ("embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    for name, sql in registry.SQL.items():
        df = registry.QUERIES[name](spark, data)
        columns = sorted(df.columns)
        want = con.sql(sql)
        names = list(want.columns)
        assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in columns) for r in want.fetchall())


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, data, none, odd):
    """Each stage keeps the columns of documents, and what it decides takes effect in the next."""
    docs = corpus_pipeline.read(spark, data, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, function in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stage(function(spark, before, data), f"test-{name}")
        if name != names[-1]:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "toxicity":
            gone = before.join(docs, "doc_id", "left_anti").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id")
            assert gone.count() == gone.filter("toxic = 1").count() or gone.filter("toxic = 1").count() > 0.5 * gone.count()
        if name == "ngram_jaccard_join":
            assert ngram_join.near_duplicates(docs).filter("n_links > 0").count() == 0
            classes = ngram_join.near_duplicates(before).select("class_id").distinct()
            assert docs.count() == classes.count()
        if name == "suffix_array_dedup":
            assert docs.count() == before.count()
            kept = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()}
            same = sum(kept[r.doc_id] == r.kept_sha256 for r in suffix_dedup.digest(before).collect())
            assert same >= 0.95 * len(kept)  # all but texts cut within a letter
        if name == "mixing":
            taken = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
            assert Counter(r.doc_id for r in docs.collect()) == Counter({k: v for k, v in taken.items() if v})
        if name == "packing":
            texts = defaultdict(list)
            for r in before.collect():
                texts[r.doc_id].append(r.text)
            check_packing(docs.collect(), texts, 4096)
    for df in (none, odd.select(*corpus_pipeline.COLUMNS)):
        for _, function in corpus_pipeline.STAGES:
            df = corpus_pipeline.stage(function(spark, df, data), "test-odd")


def test_stages_decide_on_rows_and_not_on_ids(spark, data):
    """Null ids and ids with several texts: no row goes or is taken for another's sake."""
    text = lambda k, n=30: " ".join(f"t{k}w{i}" for i in range(n))
    rows = [(None if k < 20 else 7 if k < 30 else 100 + k, text(k), "en", "ab"[k % 2], 1) for k in range(60)]
    rows += [(7, text(50), "en", "a", 1), (None, text(51), "en", "a", 1), (900, text(3), "en", "b", 1), (None, "", "en", "b", 0), (None, "", "en", "b", 0)]
    df = spark.createDataFrame(rows, DOCS)
    kept = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, df, data).collect())
    want = Counter((r[0], r[1]) for r in rows)
    # Of linked rows the smallest id stays: 7 before 150, 151 before null, 900 before null.
    for gone in ((150, text(50)), (None, text(51)), (None, text(3))):
        del want[gone]
    assert kept == want

    mixed = spark.createDataFrame([(i, t, lang, s, n) for i, t, lang, s, n in rows[:60]] + [(7, text(70, 400), "en", "a", 1)], DOCS)
    got = Counter(r.text for r in corpus_pipeline.mix_sources(spark, mixed, data).collect())
    numbered = mixed.withColumn("n", F.monotonically_increasing_id())
    copies = {r.text: r.copies for r in mixing.mix(numbered, row="n").join(numbered.select("n", "text"), "n").collect()}
    assert got == Counter({t: c for t, c in copies.items() if c})
    taken = Counter()
    for r in mixing.mix(mixed).withColumn("lost", F.col("doc_id").isNull()).collect():
        taken[r.lost] += r.copies
    assert sum(got.values()) == sum(taken.values()) and taken[True] > 0
