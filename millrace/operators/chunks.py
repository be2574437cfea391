"""Documents to overlapping chunks, and chunk-table contracts."""

from __future__ import annotations

from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Separators in the order they are tried.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "，", " ")


def _pieces(text: str, size: int) -> list[str]:
    """Chunks of one text before overlap: its parts at the first separator it has, windows of those over the size, and where a chunk starts among them."""
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    sep = next((s for s in SEPARATORS if s in text), None)
    units: list[tuple[str, bool]] = []
    for part in text.split(sep) if sep else [text]:
        if len(part) > size:
            units += [(w, True) for w in (part[i : i + size].strip() for i in range(0, len(part), size)) if w]
        elif part.strip():
            units.append((part, False))
    starts, run = [], 0
    for i, (unit, alone) in enumerate(units):
        run += len(sep or "") + len(unit)
        if alone or run > size or not starts:
            starts.append(i)
            run = len(unit)
    return [(sep or "").join(u for u, _ in units[i:j]).strip() for i, j in pairwise([*starts, len(units)])]


def chunk_text(docs: DataFrame, size: int = 400, version: str | None = None) -> DataFrame:
    """(doc_id, chunk_index, chunk) of every document; null and blank texts have none. One task per input partition, no shuffle.

    version: a text column that goes with the chunks of its row.
    """
    more = [version] if version else []

    def run(batches):
        for b in batches:
            parts = [_pieces(t or "", size) for t in b.column(1).to_pylist()]
            row = pa.array([i for i, p in enumerate(parts) for _ in p], pa.int64())
            places, texts = pa.array([k for p in parts for k in range(len(p))], pa.int32()), pa.array([c for p in parts for c in p], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), places, texts, *(b.column(2 + i).take(row) for i in range(len(more)))], ["doc_id", "chunk_index", "chunk", *more])

    schema = ", ".join(["doc_id long, chunk_index int, chunk string", *(f"{m} string" for m in more)])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(F.col(m).cast("string") for m in more)).mapInArrow(run, schema)


def chunk_overlap(chunks: DataFrame, overlap: int = 80) -> DataFrame:
    """Each chunk behind the last `overlap` characters of the one before it, which may make it size + overlap long."""
    before = F.lag("chunk").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    return chunks.withColumn("__before", before).withColumn("chunk", F.concat(F.coalesce(F.right("__before", F.lit(overlap)), F.lit("")), "chunk")).drop("__before")


def chunk_contract(chunks: DataFrame, declared: DataFrame) -> DataFrame:
    """Documents whose chunk indexes are not 0..n-1 or whose number of chunks is not the declared one."""
    got = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("chunk_index").alias("n_index"), F.min("chunk_index").alias("lo"), F.max("chunk_index").alias("hi"))
    both = declared.join(got, "doc_id", "full_outer")
    gap = (F.col("n") != F.col("n_index")) | (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1)
    wrong = F.array_compact(F.array(F.when(gap, "index_gap"), F.when(~F.coalesce(F.col("n"), F.lit(0)).eqNullSafe(F.col("n_chunks")), "count_differs")))
    return both.select("doc_id", wrong.alias("violations")).where(F.size("violations") > 0)


def _table_pieces(content: str, markdown: str, soft: int, hard: int, overlap: int) -> list[str]:
    """Runs of rows behind the table's lead and header: each as long as the soft size lets it, one row at least."""
    windows = [content[i : i + hard] for i in range(0, len(content), hard)]
    lines = markdown.splitlines()
    base = content.split("\n\n", 1)[0] + "\n\n" + "\n".join(lines[:2])
    if len(lines) < 2 or len(base) >= hard:
        return windows
    rows, room = lines[2:], hard - len(base) - 1
    if not rows:
        return [base]
    out, start, fresh = [], 0, 0
    while fresh < len(rows):
        if len(rows[fresh]) > room:
            out += [f"{base}\n{rows[fresh][i : i + room]}" for i in range(0, len(rows[fresh]), room)]
            start = fresh = fresh + 1
            continue
        end = fresh + 1
        size = len(base) + sum(1 + len(r) for r in rows[start:end])
        while end < len(rows) and len(rows[end]) <= room and size + 1 + len(rows[end]) <= soft:
            size += 1 + len(rows[end])
            end += 1
        out.append("\n".join([base, *rows[start:end]]))
        again = overlap and end < len(rows) and 1 + len(rows[end - 1]) + len(rows[end]) <= room
        start, fresh = (end - 1 if again else end), end
    return out


def chunk_tables(tables: DataFrame, soft: int = 600, hard: int = 1200, overlap: int = 0) -> DataFrame:
    """tables(table_id, content, table_markdown) to (table_id, chunk_index, chunk), the header in front of every chunk.

    The last `overlap` (0 or 1) row of a chunk opens the next where both fit. Rows over the hard size are cut; a table
    without a header, or whose header fills a chunk, is cut into windows. Null and blank contents have no chunk. No shuffle.
    """
    if overlap not in (0, 1):
        raise ValueError("overlap must be 0 or 1")

    def run(batches):
        for b in batches:
            rows = []
            for i, content, markdown in zip(*(c.to_pylist() for c in b.columns)):
                kept = filter(None, map(str.strip, _table_pieces(content or "", markdown or "", soft, hard, overlap)))
                rows += [(i, k, c) for k, c in enumerate(kept)] if (content or "").strip() else []
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], ["table_id", "chunk_index", "chunk"])

    return tables.select(F.col("table_id").cast("string"), F.col("content").cast("string"), F.col("table_markdown").cast("string")).mapInArrow(run, "table_id string, chunk_index int, chunk string")
