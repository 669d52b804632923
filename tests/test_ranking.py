"""Many ranked queries at once against plain sums, and blocks that are passed over."""

import math
import random
from collections import Counter

import pytest

from brakta.operators import ranking


def plain(texts, queries, k, k1=1.2, b=0.75):
    docs = [(i, t.lower().split()) for i, t in texts if t is not None]
    mean = sum(len(w) for _, w in docs) / len(docs)
    df = Counter(w for _, ws in docs for w in set(ws))
    out = set()
    for q, text in queries:
        scores = []
        for i, ws in docs:
            tf = Counter(ws)
            hit = [w for w in set((text or "").lower().split()) if tf[w]]
            if hit:
                scores.append((-round(sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(ws) / mean)) for w in hit), 6), i))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])}
    return out


@pytest.mark.parametrize("block", [3, 1000])
def test_best_texts_are_those_of_plain_sums(spark, block):
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(200)] + [(300, None), (301, ""), (302, "W1 w2"), (303, "w1 W2")]
    queries = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 8)))) for i in range(25)] + [(90, "unseen"), (91, ""), (92, None), (93, "W1 w1 w2")]
    got = ranking.best_texts(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string"), 5, block=block, first=2)
    assert {(r.query_id, r.place, r.doc_id, round(r.score, 6)) for r in got.collect()} == plain(texts, queries, 5)
    assert ranking.best_texts(spark.createDataFrame(texts, "doc_id long, text string").limit(0), spark.createDataFrame(queries, "query_id long, text string")).collect() == []


def test_blocks_below_the_floor_are_passed_over(spark):
    bounds = spark.createDataFrame([(1, b, float(10 - b)) for b in range(10)], "query_id long, block int, bound double")
    floor = spark.createDataFrame([(1, 6.5)], "query_id long, floor double")
    assert ranking.blocks_scored(bounds, floor, first=2).first()[1:] == (4, 10)


def test_scores_of_a_block_are_dealt_once_for_all_queries(spark):
    """No row for each posting and query: what leaves a block is at most its texts, for each query."""
    index = spark.createDataFrame([(f"t{t}", 0, key, 1.0 + t + (key or 0)) for key in (None, 1, 2, 3) for t in range(40)], "term string, block int, key long, impact double")
    asked = spark.createDataFrame([(q, [f"t{t}" for t in range(40)]) for q in range(30)] + [(99, ["unseen"])], "query_id long, terms array<string>")
    got = ranking._scored(asked.selectExpr("query_id", "0 as block"), asked, index, 2)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroups")[0]
    assert sorted(map(tuple, got.collect())) == sorted((q, key, sum(1.0 + t + key for t in range(40))) for q in range(30) for key in (2, 3))
