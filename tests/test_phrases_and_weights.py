"""Many phrases at once, folding with its way back, and weights raked to margins."""

import random
import unicodedata

import pytest

from brakta.functions import folding
from brakta.operators import phrases, weights


def test_folding_leads_back():
    for text in ("Straße", "ÅÄÖ åäö", "İstanbul ISTANBUL", "café café CAFÉ", "ﬁn ﬁ", "日本 😀 Ⅷ", "", "plain ASCII", "́lone", "Ǆ"):
        out, places = folding.folded(text)
        assert out == folding.folded(out)[0]
        assert len(places or range(len(text) + 1)) == len(out) + 1
        for i in range(len(out)):
            s, e = folding.span_in(places, text, i, i + 1)
            assert s < e and out[i] in folding.folded(text[s:e])[0]
    assert folding.folded("Straße")[0] == folding.folded("STRASSE")[0] == "strasse"
    assert folding.folded(unicodedata.normalize("NFD", "Åkerö"))[0] == folding.folded("ÅKERÖ")[0] == "akero"


def plain(text, wanted, fold, whole):
    known, places = folding.folded(text) if fold else (text, None)
    out = set()
    for number, phrase in wanted:
        p = folding.folded(phrase)[0] if fold else phrase
        at = 0
        while p and (at := known.find(p, at)) >= 0:
            end = at + len(p)
            if whole and (at and known[at - 1].isalnum() or end < len(known) and known[end].isalnum()):
                at += 1
                continue
            out.add((number, *folding.span_in(places, text, at, end)))
            at = end
    return out


@pytest.mark.parametrize("fold", [True, False])
@pytest.mark.parametrize("whole", [True, False])
def test_many_phrases_are_found_as_one_by_one(spark, monkeypatch, fold, whole):
    rng = random.Random(1)
    words = ["ab", "aba", "Åb", "straße", "STRASSE", "café", "x", "abab", "ß"]
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(40)] + ["", None, "aaaa", "ababab"]
    wanted = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((1, 1, 2, 3))))) for i in range(60)] + [(90, "aa"), (91, "aa"), (92, ""), (93, None), (94, "́")]
    rows = spark.createDataFrame([(i, 7, t) for i, t in enumerate(texts)], "doc_id long, line_no int, text string").repartition(3)
    given = spark.createDataFrame(wanted, "phrase_id long, phrase string")
    want = {(i, 7, *m) for i, t in enumerate(texts) if t for m in plain(t, [w for w in wanted if w[1]], fold, whole)}
    for limit in (phrases.PHRASES, 100):  # of one automaton, and of several
        monkeypatch.setattr(phrases, "PHRASES", limit)
        got = [tuple(r) for r in phrases.find_phrases(rows, given, ["doc_id", "line_no"], fold=fold, whole=whole).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert phrases.find_phrases(rows, given.limit(0), ["doc_id"]).collect() == []


def test_raked_weights_meet_their_margins(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b"]), rng.choice(["x", "y", "y", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, m string")
    got = weights.raked(df, {"k": {"a": 0.5, "b": 0.5}, "m": {"x": 0.75, "y": 0.25, "gone": 3.0}}, rounds=15).collect()
    assert len(got) == 400 and abs(sum(r.weight for r in got) - 400) < 1e-6
    share = lambda test: sum(r.weight for r in got if test(r))
    assert abs(share(lambda r: r.k == "a") - 200) < 0.01 and abs(share(lambda r: r.m == "x") - 3 * share(lambda r: r.m == "y")) < 1e-6
    assert [r.weight for r in weights.raked(df, {}).collect()] == [1.0] * 400
    assert weights.raked(df.limit(0), {"k": {"a": 1.0}}, 2).collect() == []


def test_weak_slices_are_made_more_of():
    new = weights.biased({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1.0, "b": 0.5}, 2.0)
    assert abs(sum(new.values()) - 1) < 1e-12 and new["b"] > 0.3 > 0.2 > new["c"] and new["a"] / new["c"] == pytest.approx(2.5)
