"""Very many phrases found in one pass over the text, by an automaton of all of them."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brakta.functions.folding import folded, span_in

#: Characters of phrases in one automaton, which every worker holds; more phrases are more passes.
PHRASES = 8 << 20
#: Places that a task hands on at a time.
ROWS = 8192


def automaton(phrases: list[tuple[int, str]], fold: bool) -> ahocorasick.Automaton:
    """Phrases that fold to the same string share a place in it."""
    out, same = ahocorasick.Automaton(), {}
    for number, phrase in phrases:
        known = folded(phrase)[0] if fold else phrase
        if known:
            same.setdefault(known, []).append(number)
    for known, numbers in same.items():
        out.add_word(known, (len(known), sorted(numbers)))
    out.make_automaton()
    return out


def word_character(ch: str) -> bool:
    return ch.isalnum()


def matches(machine: ahocorasick.Automaton, text: str, fold: bool, whole: bool, edges: bool = False) -> Iterator[tuple[int, int, int]]:
    """(phrase, start, end) in ``text``: for each phrase, from the left, those that do not overlap its last; ``whole``: only where no letter or digit touches them; ``edges``: only from the beginning of a character of the text to the end of one."""
    if not len(machine):
        return
    known, places = folded(text) if fold else (text, None)
    ends: dict[int, int] = {}
    for last, (size, numbers) in machine.iter(known):
        start, end = last + 1 - size, last + 1
        if whole and (start and word_character(known[start - 1]) or end < len(known) and word_character(known[end])):
            continue
        if edges and places is not None and (start and places[start] == places[start - 1] or places[end] == places[end - 1]):
            continue
        for number in numbers:
            if start >= ends.get(number, 0):
                ends[number] = end
                yield number, *span_in(places, text, start, end)


def find_phrases(rows: DataFrame, phrases: DataFrame, keys: list[str], text: str = "text", fold: bool = True, whole: bool = False, shown: str | None = None, edges: bool = False) -> DataFrame:
    """(keys, phrase_id, start, end): where each of ``phrases`` (phrase_id, phrase) stands in a text, in its own offsets.

    ``fold`` looks past case, diacritics and compatibility forms, also where these change lengths.  ``edges``
    leaves out what begins or ends within a character that folds to several ('s' in 'ß').  ``shown`` names a column for what stands there, so that nobody has to join the texts again.  Null or
    empty phrases, and those that fold to nothing, stand nowhere; a null text holds none.  Phrases are counted
    first; those of an automaton, PHRASES characters at most and one phrase at least, go to every task, and
    there is a pass over the texts for each automaton.  A task hands on ROWS places at a time, however many a text holds.
    """
    known = phrases.filter("phrase_id is not null and phrase <> ''").select(F.col("phrase_id").cast("long").alias("phrase_id"), "phrase")
    size = known.agg(F.sum(F.length("phrase"))).first()[0] or 0
    passes = max(1, -(-2 * size // PHRASES) if size > PHRASES else 1)
    schema = ", ".join(f"{k} {t}" for k, t in rows.select(*keys).dtypes) + ", phrase_id long, start int, end int" + (f", {shown} string" if shown else "")
    out = None
    for i in range(passes):
        chosen = [(r["phrase_id"], r["phrase"]) for r in known.filter(F.pmod(F.xxhash64("phrase_id", "phrase"), F.lit(passes)) == i).distinct().collect()]
        found = rows.filter(F.col(text).isNotNull()).select(*keys, F.col(text).alias("__text")).mapInArrow(_search(chosen, fold, whole, shown, edges), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _search(phrases: list[tuple[int, str]], fold: bool, whole: bool, shown: str | None, edges: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(phrases, fold)
        for batch in batches:
            keys = [k for k in batch.schema.names if k != "__text"]
            bodies = batch.column("__text")

            def made(found: list[tuple], batch: pa.RecordBatch = batch, keys: list[str] = keys) -> pa.RecordBatch:
                row, number, starts, ends, held = zip(*found, strict=True)
                taken = batch.select(keys).take(pa.array(row, pa.int64()))
                columns = [*taken.columns, pa.array(number, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
                names = [*keys, "phrase_id", "start", "end"]
                return pa.RecordBatch.from_arrays([*columns, pa.array(held, pa.string())], [*names, shown]) if shown else pa.RecordBatch.from_arrays(columns, names)

            found = []
            for i in range(batch.num_rows):
                body = bodies[i].as_py()
                for phrase, start, end in matches(machine, body, fold, whole, edges):
                    found.append((i, phrase, start, end, body[start:end] if shown else None))
                    if len(found) == ROWS:
                        yield made(found)
                        found = []
            if found:
                yield made(found)

    return run
