"""Spelling variants: each word beside the far more frequent word that is one edit away.

Two words are near if one inserted, deleted or replaced code point tells them apart.
An edit at place p leaves the word before p and the word after p, so the words near
a word are the points of rectangles: for each p, an interval of the words in
forward order (those that begin alike) by one of the words in reverse order (those
that end alike).  Words of one length are indexed by themselves, so a rectangle
holds what is near and nothing else; a wavelet tree reports it (``wavelet``).

Dealing.  Words of length L and L + 1 meet in class L, which finds replacements
within L and insertions from L into L + 1.  A class has a window of places for each
half of the word: edits in one half leave the other half alone, so words are dealt
by that half.  Where more than ``hot`` words share one, the window is cut in two,
again and again: down to one place, at which but few can share all the rest.  So no
task holds more than its share, whatever half is frequent, and each near pair is
found once, at its last place.

Counting.  Runs of letters are counted within each batch of texts before words are
dealt.  Null texts have no run; a null id counts as the empty text in the hash.
Repeated rows count as often as they stand.  Very long runs are words like others.
Lists of words never reach the driver.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brakta.llm.common import texts
from brakta.llm.components import hub_join
from brakta.llm.wavelet import WaveletTree
from brakta.plans.staging import stage, unstage

LETTERS = r"[A-Za-zÀ-ÿ]"
#: Words that may share a half before its window is cut; code points of words in a task, about; distinct words held while counting.
HOT, TASK, HELD = 20_000, 1 << 20, 200_000
CLASS = "word string, n long, size int, lo int, hi int"


def word_counts(docs: DataFrame, least: int = 7, often: int = 2, every: int = 31, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the distinct words of at least ``least`` code points with at least ``often`` occurrences.

    Runs of letters have A-Z in lower case; where ``every`` divides the crc32 of id and run, the run loses
    a code point before it is a word.
    """
    runs = re.compile(f"{LETTERS}{{{least},}}")
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text")).filter("text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})
            total.clear()
            return out

        held = 0
        for batch in batches:
            for name, body in zip(batch.column("id").to_pylist(), texts(batch), strict=True):
                seed = zlib.crc32(f"{name}:".encode())
                for run, n in Counter(runs.findall(body.encode().lower().decode())).items():
                    h = zlib.crc32(run.encode(), seed)
                    if h % every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least:
                            continue
                    if run not in total:
                        held += 64 + len(run)
                    total[run] += n
                if held > HELD * 80:
                    yield flushed()
                    held = 0
        if total:
            yield flushed()

    found = rows.mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


def ordered(words: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(order, rank, how much each has in common with the one before it) of words, in code-point order."""
    order = sorted(range(len(words)), key=words.__getitem__)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    return order, rank, np.array([0, *(_common(words[a], words[b]) for a, b in zip(order, order[1:], strict=False))], np.int64)


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def intervals(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place in an order, the first and last + 1 of those that agree with it in ``depth`` code points."""
    n = len(common)
    cut = common < depth
    cut[0] = True
    group = np.cumsum(cut) - 1
    starts = np.flatnonzero(cut)
    return starts[group], np.append(starts[1:], n)[group]


def near_pairs(words: list[str], size: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of places in ``words``, which have ``size`` or ``size`` + 1 code points, that an edit at a place in [lo, hi) tells apart.

    a has ``size``; b has as many (then both orders are returned) or one more.
    """
    short = np.array([len(w) == size for w in words])
    if not short.any() or len(words) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    forward, fore, ahead = ordered(words)
    backward, back, behind = ordered([w[::-1] for w in words])
    of = np.flatnonzero(short)
    indexes = []  # for each length: places of its words in forward order, counts before each place in either order, the tree
    for kind in (short, ~short):
        in_forward, in_backward = kind[forward], kind[backward]
        before_f, before_b = (np.concatenate([[0], np.cumsum(x)]) for x in (in_forward, in_backward))
        held = np.array(forward)[in_forward]
        ends = np.array(backward)[in_backward]
        indexes.append((before_f, before_b, ends, WaveletTree(before_b[back[held]]) if len(held) else None))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # Beyond what any two have in common nothing is near.
    first, last = max(lo, size - 1 - int(behind.max(initial=0))), min(hi, int(ahead.max(initial=0)) + 1, size + 1)
    asked: list[list] = [[], []]
    for p in range(first, last):
        f0, f1 = (x[fore[of]] for x in intervals(ahead, p))
        for longer in (0, 1):
            before_f, before_b, ends, tree = indexes[longer]
            if tree is None or (not longer and p >= size):
                continue
            b0, b1 = (x[back[of]] for x in intervals(behind, size - p - 1 + longer))
            low, high, bottom, top = before_f[f0], before_f[f1], before_b[b0], before_b[b1]
            some = (high - low > 1 - longer) & (top - bottom > 1 - longer)
            if some.any():
                asked[longer].append((of[some], np.full(int(some.sum()), p), low[some], high[some], bottom[some], top[some]))
    for longer in (0, 1):
        if not asked[longer]:
            continue
        a, p, *box = (np.concatenate(x) for x in zip(*asked[longer], strict=True))
        which, value = indexes[longer][3].report(*box)
        a, p, b = a[which], p[which], indexes[longer][2][value]
        if longer:  # an insertion into a run of its own kind has many places; the last one counts
            keep = np.array([at == size or words[y][at] != words[x][at] for x, y, at in zip(a.tolist(), b.tolist(), p.tolist(), strict=True)], bool)
        else:
            keep = a != b
        found.append((a[keep], b[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def windows(words: DataFrame) -> DataFrame:
    """Each word in its two classes, and in each in the window of either half."""
    length = F.length("word")
    sizes = F.explode(F.array(length, length - 1)).alias("size")
    half = F.floor(F.col("size") / 2).cast("int")
    both = F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), (F.col("size") + 1).alias("hi")))
    return words.select("word", "n", sizes).select("word", "n", "size", F.explode(both).alias("w")).select("word", "n", "size", "w.lo", "w.hi").filter("lo < hi")


def shared_part() -> F.Column:
    """What the words of a window have in common: their class, the window, and what lies before and after it."""
    after = F.greatest(F.lit(0), F.col("size") - F.col("hi"))
    return F.xxhash64("size", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), F.when(after > 0, F.expr("right(word, greatest(0, size - hi))")).otherwise(F.lit("")))


def dealt(words: DataFrame, hot: int = HOT) -> DataFrame:
    """``windows``, cut in two wherever more than ``hot`` words share what lies outside; with the key they are dealt by."""
    rows, done = windows(words).withColumn("key", shared_part()), []
    while True:
        counts = stage(rows.filter("hi - lo > 1").groupBy("key").agg(F.count("*").alias("n")), "spelling-keys")
        total, most = counts.agg(F.sum("n"), F.max("n")).first()
        if (most or 0) <= hot:
            unstage(counts)
            done.append(rows)
            break
        of = counts.select("key", (F.col("n") > hot).alias("m"), F.col("n").alias("n_key")).withColumnRenamed("n_key", "n")
        cut = stage(hub_join(rows.filter("hi - lo > 1").withColumnRenamed("n", "n_word"), of, "key", total).withColumnRenamed("n_word", "n"), "spelling-windows")
        unstage(counts)
        done += [rows.filter("hi - lo <= 1"), cut.filter(~F.col("m")).select(rows.columns)]
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi")))).alias("w")
        rows = cut.filter("m").select("word", "n", "size", halves).select("word", "n", "size", "w.lo", "w.hi").withColumn("key", shared_part())
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, n_near, best) for each word that has a near one; best is (-n, word) of the first by number and order."""
    rows = dealt(words, hot)
    weight = words.agg(F.sum(F.length("word") + 8)).first()[0] or 0
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, 4 * weight // TASK)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], tuple[list, list]] = {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("word", "n", "size", "lo", "hi")]
            for word, n, *kind in zip(*columns, strict=True):
                in_class = held.setdefault(tuple(kind), ([], []))
                in_class[0].append(word)
                in_class[1].append(n)
        for kind in list(held):
            own, n = held.pop(kind)
            a, b = near_pairs(own, *kind)
            if len(a):
                yield told(own, n, a, b, kind[0])

    def told(own: list[str], n: list[int], a: np.ndarray, b: np.ndarray, size: int) -> pa.RecordBatch:
        inserted = np.array([len(w) for w in own])[b] > size
        a, b = np.concatenate([a, b[inserted]]), np.concatenate([b, a[inserted]])  # insertions were found from the shorter word only
        count: Counter = Counter()
        best: dict[int, tuple[int, str]] = {}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            count[x] += 1
            other = (-n[y], own[y])
            if x not in best or other < best[x]:
                best[x] = other
        at = list(count)
        return pa.RecordBatch.from_pydict({
            "word": pa.array([own[x] for x in at], pa.string()), "n_near": pa.array([count[x] for x in at], pa.int64()),
            "less": pa.array([best[x][0] for x in at], pa.int64()), "form": pa.array([best[x][1] for x in at], pa.string())})

    found = rows.repartition(tasks, "key").drop("key").mapInArrow(search, "word string, n_near long, less long, form string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))


def variants(words: DataFrame, ratio: int = 10, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for ``words`` (word, n).

    A form is at least ``ratio`` times as frequent, so chains end, after as many steps as numbers have
    digits; each round of staged joins doubles what is followed.
    """
    found = near_words(words, hot).withColumn("form_n", -F.col("best.less"))
    told = stage(words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form_n") >= ratio * F.col("n"), F.struct(F.col("best.form").alias("form"), "form_n")).alias("f")
    ).select("word", "n", "n_near", "f.form", "f.form_n"), "spelling-words")
    chain = stage(told.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = chain.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nearer = stage(chain.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        unstage(chain)
        chain = nearer.select("word", "root")
        if not nearer.filter("moved").limit(1).count():
            break
    return told.join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least: int = 7, often: int = 2, every: int = 31, ratio: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``variants`` of the words of ``docs``.  Runs the count of words, the search, and a join a round of roots."""
    return variants(stage(word_counts(docs, least, often, every, key, text), "spelling-counts"), ratio)
