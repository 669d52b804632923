"""Token counts by the whole-token shortcut.

Offline, on the driver, every vocabulary string is encoded alone; those that
come out as one token are shipped with the task (their number is bounded by the
vocabulary).  A pre-token found among them counts as one without any merging;
only the rest is merged by the model, and remembered in a bounded table.

Null and empty texts have 0 tokens.  Texts of any length are counted whole.
Ids may be null or repeated; every row is answered by itself.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brakta.llm.bpe import SEPARATORS, WordBpe
from brakta.llm.common import Memo, map_arrow, texts


def counter(path: str, single: list[str]) -> Callable[[str], int]:
    """text -> its number of tokens."""
    try:
        own = WordBpe(path)
    except ValueError:
        return library_counter(path)
    proven = frozenset(single)
    model = Memo(lambda piece: len(own.model.tokenize(piece)))

    def chunk_count(chunk: str) -> int:
        pieces = own.pre_tokens(chunk)
        if pieces is None:
            return len(own.library.encode(chunk, add_special_tokens=False).ids)
        return sum(1 if piece in proven else model[piece] for piece in pieces)

    get = Memo(chunk_count, base=dict.fromkeys(single, 1)).__getitem__

    def count(text: str) -> int:
        if any(c in text for c in SEPARATORS):
            return len(own.library.encode(text, add_special_tokens=False).ids)
        return sum(map(get, text.split()))

    return count


def library_counter(path: str) -> Callable[[str], int]:
    """Other vocabularies: whole texts through their own library."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(pieces.encode(text))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return lambda text: len(library.encode(text, add_special_tokens=False).ids)


def proven_singles(path: str) -> list[str]:
    """The strings for the shortcut; none where a vocabulary does not encode chunk by chunk."""
    try:
        own = WordBpe(path)
    except ValueError:
        return []
    # A lower-case ASCII word is read by the model as it stands, so one list serves pre-tokens and chunks.
    return [w for w in own.single_tokens() if w.isascii() and own.pre_tokens(w) == [w]]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``."""
    single = proven_singles(tokenizer)

    def make():
        count = counter(tokenizer, single)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = pa.array([count(x) for x in texts(batch)], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

        return step

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    counted = map_arrow(rows, make, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
