"""Edit logs of pages, replayed: which version a page shows after each entry, with undo and redo."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Versions that an undo can go back to; of more, the oldest are forgotten.
LIMIT = 100


def versions(log: DataFrame, page: str, order: list[str], kind: str, version: str, limit: int = LIMIT) -> DataFrame:
    """(page, version, kind, shown, before, can_undo, can_redo) for each entry of a log.

    ``kind`` is edit, undo or redo; ``version`` names the entry, and with it what an edit makes of the page.
    ``shown`` is the version after the entry, null for the page as it came; ``before`` the one that the entry
    found.  An edit forgets what could be redone; an undo or redo without anything to go to, and an entry of
    another kind, change nothing.  A null page is a page.  Ties in ``order`` go by ``version``.

    Logs are dealt by page and sorted; a task reads them as they come and holds the two stacks of one page,
    at most ``limit`` versions each, however long a log is.
    """
    entries = log.select(F.col(page).alias("page"), F.col(version).cast("long").alias("version"), F.col(kind).alias("kind"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)])
    dealt = entries.repartition("page").sortWithinPartitions("page", *[f"__o{i}" for i in range(len(order))], "version").select("page", "version", "kind")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shown = object(), None
        undo: deque = deque(maxlen=limit)
        redo: list = []
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for own, number, what in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != at or type(own) is not type(at):
                    at, shown, redo = own, None, []
                    undo.clear()
                before = shown
                if what == "edit":
                    undo.append(shown)
                    redo.clear()
                    shown = number
                elif what == "undo" and undo:
                    redo.append(shown)
                    shown = undo.pop()
                elif what == "redo" and redo:
                    undo.append(shown)
                    shown = redo.pop()
                for column, x in zip(out, (shown, before, bool(undo), bool(redo)), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.bool_())], ["page", "version", "kind", "shown", "before", "can_undo", "can_redo"])

    kinds = dict(entries.dtypes)
    return dealt.mapInArrow(replay, f"page {kinds['page']}, version long, kind string, shown long, before long, can_undo boolean, can_redo boolean").withColumnRenamed("page", page)


def sql(log: str, page: str, order: str, limit: int = LIMIT) -> str:
    """The same in DuckDB for ``log`` (page, version, kind, ...): all pages side by side, an entry of each a step."""
    return f"""
        WITH RECURSIVE n AS (
            SELECT {page}, version, kind, row_number() OVER (PARTITION BY {page} ORDER BY {order}, version) AS k FROM {log}
        ), replay AS (
            SELECT DISTINCT {page}, 0::BIGINT AS k, NULL::BIGINT AS version, NULL::VARCHAR AS kind, NULL::BIGINT AS shown, NULL::BIGINT AS before, []::BIGINT[] AS back, []::BIGINT[] AS ahead FROM n
            UNION ALL
            SELECT n.{page}, n.k, n.version, n.kind,
                   CASE WHEN n.kind = 'edit' THEN n.version WHEN n.kind = 'undo' AND len(back) > 0 THEN back[-1] WHEN n.kind = 'redo' AND len(ahead) > 0 THEN ahead[-1] ELSE shown END,
                   shown,
                   CASE WHEN n.kind = 'edit' OR n.kind = 'redo' AND len(ahead) > 0 THEN list_append(back, shown)[-{limit}:] WHEN n.kind = 'undo' THEN back[:-2] ELSE back END,
                   CASE WHEN n.kind = 'edit' THEN [] WHEN n.kind = 'undo' AND len(back) > 0 THEN list_append(ahead, shown) WHEN n.kind = 'redo' THEN ahead[:-2] ELSE ahead END
            FROM replay r JOIN n ON n.{page} = r.{page} AND n.k = r.k + 1
        )
        SELECT {page}, version, kind, shown, before, len(back) > 0 AS can_undo, len(ahead) > 0 AS can_redo FROM replay WHERE k > 0
    """
