"""Language identification by compression.

For every language a raw-content zstandard dictionary is made of training
texts.  A text, in lower case, is encoded with each of them, block by block, and goes to the
language that needs the fewest bytes, of equal ones to the one with more training
texts (then by code point); a narrow margin is flagged as rejected.
All of a text is encoded: blocks keep the dictionary's help from fading in long
texts, and a very long text is just many blocks.

``und``, score 0: null and empty texts and those without a letter.  When no
language was learned (an empty training set) every text is ``und``.  Languages
whose training texts are empty are not learned; all others are, however rare.
Repeated rows are learned from once.
"""

from __future__ import annotations

import math

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brakta.llm.common import map_arrow

LEVEL = 6


def spread_slices(text: str, share: str, phase: str, width: int) -> Column:
    """About ``share`` characters of a text: slices of ``width`` (one of ``share``, if that is less) evenly spaced over its whole length, from a start told by ``phase``, 0 to 1."""
    length, n = F.length(text), F.greatest(F.lit(1), F.floor(F.col(share) / width)).cast("int")
    wide = F.least(F.col(share), F.lit(width)).cast("int")
    start = lambda i: (F.floor((i + F.col(phase)) / n * F.greatest(length - wide, F.lit(0))) + 1).cast("int")
    return F.when(length <= F.col(share), F.array(text)).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col(text).substr(start(i), wide)))


def learn(train: DataFrame, sample_rows: int = 1500, dictionary_bytes: int = 110_000, width: int = 200, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionaries from about ``sample_rows`` documents of each language, ``dictionary_bytes`` for each at most.

    The sample is drawn by hash of id and text, language by language, the most frequent first.  Its documents share the bytes
    evenly, each with slices from all over its length.  The driver sees the dictionaries' bytes and one
    row a language, which is as many as there are dictionaries.
    """
    rows = train.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key, text).alias("at"))
    counted = rows.groupBy("lang").agg(F.approx_count_distinct("at").alias("n")).withColumns({
        "cut": F.lit(float(sample_rows)) / F.col("n"), "share": F.floor(F.lit(dictionary_bytes) / F.least(F.col("n"), F.lit(sample_rows)))})
    draw = F.pmod(F.xxhash64("at", F.lit(20)), F.lit(1 << 30)) / (1 << 30)
    picked = rows.join(F.broadcast(counted), "lang").filter(draw < F.col("cut")).withColumn("phase", F.pmod(F.xxhash64("at", F.lit(21)), F.lit(1 << 20)) / (1 << 20))
    got = picked.select("lang", "n", "at", spread_slices("text", "share", "phase", width).alias("slices")).distinct().collect()
    per: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (-r["n"], r["lang"], r["at"], r["slices"])):
        per.setdefault(r["lang"], []).append(r["slices"])
    out = {}
    for name, lists in per.items():
        parts = []
        for own in lists:
            # Letters of several bytes: every slice gives up its end, and none its place.
            each = max(1, dictionary_bytes // len(lists) // len(own) - 1)
            parts += [x.lower().encode("utf-8", "replace")[:each] for x in own]
        if made := b"\n".join(parts).strip():
            out[name] = made
    return out


class Coder:
    """Encoded sizes of a text under every dictionary; of equal ones the first given counts."""

    def __init__(self, dictionaries: dict[str, bytes], block: int = 2048):
        self.names, self.block, self.coders = list(dictionaries), block, []
        for name in self.names:
            made = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> list[int]:
        data = text.lower().encode("utf-8", "replace")
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        return [sum(len(code(b)) for b in blocks) for code in self.coders]

    def classify(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """(language, score, rejected): score is the share the best gets when each bit saved halves a rival's odds, over at most 64 bytes."""
        if text is None or not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        sizes = self.sizes(text)
        least = min(sizes)
        best = sizes.index(least)
        # A byte weighs less in longer texts, so that scores keep apart beyond a few hundred bytes.
        unit = max(1.0, least / 64)
        score = 1 / sum(2.0 ** (-8 * min((s - least) / unit, 64)) for s in sizes)
        second = min((s for i, s in enumerate(sizes) if i != best), default=math.inf)
        return self.names[best], score, bool(second - least < margin * least)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], held_out: Column, margin: float = 0.01, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row; rejected where the runner-up is within ``margin``."""

    def make():
        coder = Coder(dictionaries)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [coder.classify(x, margin) for x in batch.column("text").to_pylist()]
            columns = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

        return step

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    return map_arrow(rows, make, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
