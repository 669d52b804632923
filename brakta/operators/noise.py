"""Noise as an OCR engine makes it, with every labelled mention carried along.

Each decision is a draw told by the row's key, the line, the place in it and the
kind of decision, so the noise of a place does not depend on what was drawn before
it: a text is noised in a few passes over its code points, and SQL can say the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters and what they are read as.
CONFUSED = {"l": "1I", "1": "lI", "I": "1l", "O": "0", "0": "O", "o": "0", "B": "8", "8": "B", "S": "5", "5": "S", "Z": "2", "2": "Z", "G": "6", "6": "G", ":": "."}
# Letters that lose their diacritic, and vowels that gain one.
PLAIN = {"å": "a", "ä": "a", "ö": "o", "Å": "A", "Ä": "A", "Ö": "O"}
MARKED = {"a": "åä", "o": "ö", "A": "ÅÄ", "O": "Ö"}
# Fixed value: chance that a chosen vowel gains a diacritic. A chosen letter with one always loses it: it is confused with nothing else.
GAIN = 0.10
# Rates as multiples of the row's: rn read as m, m as rn, letters with diacritics.
RN_M, M_RN, DIACRITIC = 0.5, 0.4, 3.0
# What happens to a chosen space, by running share; the third on structured lines, the fourth on long ones, and the share of bars among columns.
DELETE, DOUBLE, COLUMN, WRAP, LONG_LINE, BAR = 0.25, 0.50, 0.78, 0.95, 40, 0.4

#: Kinds of draws.
READ_RN, READ_M, READ, GAINS, WHICH, SPACE, HOW, BARRED = range(8)
PRIME = 2147483647

Draws = Callable[[int, np.ndarray, np.ndarray], np.ndarray]


def place_mentions(text: str, mentions: Iterable[str]) -> list[tuple[int, int]]:
    """One span for each list item, if it finds a free place: long mentions choose first, each the leftmost."""
    taken: list[tuple[int, int]] = []
    for mention in sorted((m for m in mentions if m), key=len, reverse=True):
        at = text.find(mention)
        while at >= 0 and any(at < e and s < at + len(mention) for s, e in taken):
            at = text.find(mention, at + 1)
        if at >= 0:
            taken.append((at, at + len(mention)))
    return sorted(taken)


def draws_of(key: str, seed: int = 42) -> Draws:
    """Draws in [0, 1) of a row: two squarings modulo a prime of a sum that tells kind, line and place apart.  No step leaves 64 bits."""
    own = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16) % PRIME

    def draw(kind: int, line: np.ndarray, place: np.ndarray) -> np.ndarray:
        a = (own + line * 40503 + place * 69621 + kind * 16807) % PRIME * 48271 % PRIME
        b = (a * a + own) % PRIME
        return (b * b + a) % PRIME / PRIME

    return draw


def draw_sql(kind: int, own: str = "own", line: str = "line", place: str = "place") -> str:
    a = f"((({own} + {line} * 40503 + {place} * 69621 + {kind * 16807}) % {PRIME}) * 48271 % {PRIME})"
    b = f"(({a} * {a} + {own}) % {PRIME})"
    return f"((({b} * {b} + {a}) % {PRIME}) / {PRIME}.0::DOUBLE)"


_SLOTS = 1 << 9  # all characters with a rule are below it
_READS = np.zeros((_SLOTS, 2), np.uint32)
_MANY = np.zeros(_SLOTS, np.int64)
for _c, _options in (CONFUSED | PLAIN).items():
    _READS[ord(_c), : len(_options)] = [ord(x) for x in _options]
    _MANY[ord(_c)] = len(_options)
_MARKS = np.zeros((_SLOTS, 2), np.uint32)
_MARKED = np.zeros(_SLOTS, np.int64)
for _c, _options in MARKED.items():
    _MARKS[ord(_c), : len(_options)] = [ord(x) for x in _options]
    _MARKED[ord(_c)] = len(_options)
_ACCENTED = np.zeros(_SLOTS, bool)
_ACCENTED[[ord(c) for c in PLAIN]] = True
_PIECES = [" ", "", "  ", " | ", "   ", "\n"]


def noised_text(text: str, draw: Draws, rate: float) -> tuple[str, np.ndarray]:
    """The text with noise, and where each place of it begins in that (and its end)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    breaks = codes == 10
    line = np.cumsum(breaks) - breaks  # a line end belongs to the line it ends
    starts = np.concatenate([[0], np.flatnonzero(breaks) + 1])
    place = np.arange(n) - starts[line]
    size, out = np.ones(n, np.int64), codes.copy()
    after = np.append(codes[1:], 0)

    def at(where: np.ndarray, kind: int) -> np.ndarray:
        return draw(kind, line[where], place[where])

    pairs = np.flatnonzero((codes == ord("r")) & (after == ord("n")))
    pairs = pairs[at(pairs, READ_RN) < RN_M * rate]
    wide = np.flatnonzero(codes == ord("m"))
    wide = wide[at(wide, READ_M) < M_RN * rate]
    small = np.minimum(codes, _SLOTS - 1)
    ruled = np.flatnonzero((_MANY[small] > 0) | (_MARKED[small] > 0))
    ruled = ruled[at(ruled, READ) < np.where(_ACCENTED[small[ruled]], DIACRITIC * rate, rate)]
    which, code = at(ruled, WHICH), small[ruled]
    gains = (_MARKED[code] > 0) & (at(ruled, GAINS) < GAIN)
    chosen = np.where(gains, _MARKS[code, (which * _MARKED[code]).astype(int)], _READS[code, (which * _MANY[code]).astype(int)])
    out[ruled] = np.where(gains | (_MANY[code] > 0), chosen, codes[ruled])
    out[pairs], size[pairs + 1] = ord("m"), 0
    size[wide] = 2

    # Spaces: the length that a line has by now decides whether it may wrap, once, at its first space that draws so.
    length = np.bincount(line, size * ~breaks, len(starts))
    bars = np.bincount(line, (codes == ord("|")) | ((codes == 32) & (after == 32)), len(starts)) > 0
    spaces = np.flatnonzero(codes == 32)
    spaces = spaces[at(spaces, SPACE) < rate]
    how, of = at(spaces, HOW), line[spaces]
    kind = np.zeros(len(spaces), np.int64)
    wraps = (how < WRAP) & (length[of] > LONG_LINE) & ~((how < COLUMN) & bars[of]) & (how >= DOUBLE)
    first = np.flatnonzero(wraps)
    kind[first[np.unique(of[first], return_index=True)[1]]] = 5
    columns = (how >= DOUBLE) & (how < COLUMN) & bars[of]
    kind[columns] = np.where(at(spaces[columns], BARRED) < BAR, 3, 4)
    kind[how < DOUBLE] = 2
    kind[how < DELETE] = 1
    size[spaces] = np.array([len(p) for p in _PIECES])[kind]

    begins = np.concatenate([[0], np.cumsum(size)])
    made = np.full(int(begins[-1]), 32, np.uint32)
    one = size == 1
    made[begins[:-1][one]] = out[one]
    made[begins[wide]], made[begins[wide] + 1] = ord("r"), ord("n")
    made[begins[spaces[kind == 5]]] = 10
    made[begins[spaces[kind == 3]] + 1] = ord("|")
    return made.tobytes().decode("utf-32-le", "surrogatepass"), begins


def noised(text: str, entities: dict[str, list[str]], draw: Draws, rate: float = 0.06) -> tuple[str, dict[str, list[str]]]:
    """Text with noise, and each label's mentions as they now stand in it, each once; what cannot be found any more is left out."""
    if not text or rate <= 0:
        return text, {k: list(dict.fromkeys(m for m in v if m and m in text)) for k, v in entities.items()}
    out, begins = noised_text(text, draw, rate)
    found = {}
    for label, mentions in entities.items():
        cut = (out[begins[s] : begins[e]] for s, e in place_mentions(text, mentions))
        found[label] = list(dict.fromkeys(m for m in cut if m and m in out))
    return out, found


def ocr_noise(text: Column, entities: Column, key: Column, rate: float = 0.06, seed: int = 42) -> Column:
    """struct(text, entities) with noise; the same for the same key and seed."""

    @F.pandas_udf("text string, entities map<string,array<string>>")
    def run(texts: pd.Series, maps: pd.Series, keys: pd.Series) -> pd.DataFrame:
        rows = []
        for t, m, k in zip(texts, maps, keys, strict=True):
            pairs = dict(m) if m is not None else {}
            rows.append(noised(t or "", {a: list(b) for a, b in pairs.items()}, draws_of(k, seed), rate))
        return pd.DataFrame(rows, columns=["text", "entities"])

    return run(text, entities, key.cast("string"))


def with_noisy_copies(rows: DataFrame, key: str, rate: float = 0.06, seed: int = 42) -> DataFrame:
    """Rows and a noisy copy of each, in the same split; the copy names no employer. rows: (key, text, entities, split), and company if there is one."""
    noisy = rows.withColumn("n", ocr_noise(F.col("text"), F.col("entities"), F.col(key), rate, seed)).withColumns({"text": F.col("n.text"), "entities": F.col("n.entities")}).drop("n")
    if "company" in rows.columns:  # it may not stand in the noisy text as it is
        noisy = noisy.withColumn("company", F.lit(None).cast(rows.schema["company"].dataType))
    return rows.withColumn("noisy", F.lit(False)).unionByName(noisy.withColumn("noisy", F.lit(True)))


def line_flags(text: Column) -> Column:
    """(structured, length) of each line."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.struct((x.contains("|") | x.contains("  ")).alias("structured"), F.length(x).alias("length")))


def noisy_sql(rows: str, key: str, rate: float = 0.06, seed: int = 42) -> str:
    """The noised texts of ``rows`` (key, text) in DuckDB: (key, text), line by line and place by place."""
    options = lambda table: "CASE c " + " ".join(f"WHEN '{c}' THEN '{o}'" for c, o in table.items()) + " ELSE '' END"
    inside = lambda kind: draw_sql(kind, place="(i - 1)")
    pick = lambda text, draw: f"substr({text}, 1 + CAST(floor({draw} * length({text})) AS BIGINT), 1)"
    accented = ", ".join(f"'{c}'" for c in PLAIN)
    ruled = "".join(sorted({*CONFUSED, *PLAIN, *MARKED}))
    return f"""
        WITH texts AS (
            SELECT {key}, ('0x' || sha256('{seed}:' || {key})[1:8])::BIGINT % {PRIME} AS own, string_split(text, chr(10)) AS parts FROM {rows}
        ), by_line AS (
            SELECT {key}, own, n - 1 AS line, parts[n] AS body, regexp_extract_all(parts[n], '(?s).') AS cs FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS n FROM texts)
        ), read AS (
            SELECT *, list_transform(cs, lambda c, i: CASE
                WHEN c = 'r' AND cs[i + 1] = 'n' AND {inside(READ_RN)} < {RN_M}::DOUBLE * {rate}::DOUBLE THEN 'm'
                WHEN c = 'n' AND i > 1 AND cs[i - 1] = 'r' AND {draw_sql(READ_RN, place="(i - 2)")} < {RN_M}::DOUBLE * {rate}::DOUBLE THEN ''
                WHEN c = 'm' AND {inside(READ_M)} < {M_RN}::DOUBLE * {rate}::DOUBLE THEN 'rn'
                WHEN contains('{ruled}', c) AND {inside(READ)} < CASE WHEN c IN ({accented}) THEN {DIACRITIC}::DOUBLE * {rate}::DOUBLE ELSE {rate}::DOUBLE END THEN
                    CASE WHEN {options(MARKED)} <> '' AND {inside(GAINS)} < {GAIN}::DOUBLE THEN {pick(options(MARKED), inside(WHICH))}
                         WHEN {options(CONFUSED | PLAIN)} <> '' THEN {pick(options(CONFUSED | PLAIN), inside(WHICH))} ELSE c END
                ELSE c END) AS pieces
            FROM by_line
        ), spaced AS (
            SELECT *, length(array_to_string(pieces, '')) > {LONG_LINE} AS long, contains(body, '|') OR contains(body, '  ') AS barred,
                   list_transform(cs, lambda c, i: CASE WHEN c = ' ' AND {inside(SPACE)} < {rate}::DOUBLE THEN {inside(HOW)} END) AS how
            FROM read
        ), wrapped AS (
            SELECT *, list_position(list_transform(how, lambda x: long AND x >= {DOUBLE}::DOUBLE AND x < {WRAP}::DOUBLE AND NOT (barred AND x < {COLUMN}::DOUBLE)), true) AS wrap FROM spaced
        ), lines_made AS (
            SELECT {key}, line, array_to_string(list_transform(pieces, lambda p, i: CASE
                WHEN how[i] IS NULL THEN p
                WHEN how[i] < {DELETE}::DOUBLE THEN ''
                WHEN how[i] < {DOUBLE}::DOUBLE THEN '  '
                WHEN how[i] < {COLUMN}::DOUBLE AND barred THEN CASE WHEN {inside(BARRED)} < {BAR}::DOUBLE THEN ' | ' ELSE '   ' END
                WHEN i = wrap THEN chr(10) ELSE p END), '') AS body
            FROM wrapped
        )
        SELECT {key}, string_agg(body, chr(10) ORDER BY line) AS text FROM lines_made GROUP BY {key}
    """
