"""Text to rows: clauses, line items, tables, chunks, memories."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MARK = "\x01"


def _sections(text: Column, opens: str, least: int = 3) -> Column:
    """Trimmed lines of at least `least` characters, joined by newlines and cut before each line that matches `opens`.

    Within the row and linear: opening lines get a mark, and the joined text is split at the marks.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    marked = F.transform(lines, lambda x: F.when(x.rlike(opens), F.concat(F.lit(_MARK), x)).otherwise(x))
    joined = F.regexp_replace(F.array_join(marked, "\n"), f"^{_MARK}", "")
    return F.filter(F.split(joined, f"\n{_MARK}"), lambda x: x != "")


def split_clauses(df: DataFrame, id: str, text: str, start_patterns: list[str]) -> DataFrame:
    """id, clause_no (from 1), content, length. Text before the first start is clause 1. No shuffle."""
    opens = "|".join(f"(?:{p})" for p in start_patterns)
    out = df.select(id, F.posexplode(_sections(F.col(text), opens)).alias("_n", "content"))
    return out.select(id, (F.col("_n") + 1).alias("clause_no"), "content", F.length("content").alias("length"))


def extract_items(df: DataFrame, id: str, text: str, opens: str, fields: dict[str, str]) -> DataFrame:
    """Line items: a line matching `opens` starts one (its group 1 is the name); of each field's pattern the last match
    among the item's lines wins."""
    section = df.select(id, F.posexplode(_sections(F.col(text), f"^(?:{opens})")).alias("item_no", "_s")).where(F.col("_s").rlike(f"^(?:{opens})"))
    last = {k: F.try_element_at(F.regexp_extract_all("_s", F.lit(p), F.lit(1)), F.lit(-1)) for k, p in fields.items()}
    return section.select(id, "item_no", F.regexp_extract("_s", opens, 1).alias("name"), *[v.alias(k) for k, v in last.items()])


def extract_tables(df: DataFrame, id: str, text: str, line: str = r"\|", gap: int = 3, sep: str = r"\|") -> DataFrame:
    """id, table_no, row_no, cell_no, cell of table lines; lines up to `gap` apart belong to one table."""
    lines = df.select(id, F.posexplode(F.split(text, "\n")).alias("_p", "_l")).where(F.col("_l").rlike(line))
    w = Window.partitionBy(id).orderBy("_p")
    lines = lines.withColumn("_new", F.when(F.col("_p") - F.lag("_p").over(w) <= gap, 0).otherwise(1))
    lines = lines.withColumns({"table_no": F.sum("_new").over(w).cast("int")})
    rows = lines.withColumn("row_no", F.row_number().over(Window.partitionBy(id, "table_no").orderBy("_p")))
    cells = F.split(F.regexp_replace(F.trim("_l"), r"^\||\|$", ""), sep)
    return rows.select(id, "table_no", "row_no", F.posexplode(cells).alias("cell_no", "cell")).withColumn("cell", F.trim("cell"))


def chunk_fixed(df: DataFrame, id: str, text: str, size: int = 1000) -> DataFrame:
    """id, chunk_index, text slices of `size` characters."""
    n = F.ceil(F.length(text) / size).cast("int")
    at = df.where(F.length(text) > 0).select(id, text, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    return at.select(id, "chunk_index", F.substring(F.col(text), F.col("chunk_index") * size + 1, F.lit(size)).alias("chunk"))


BREAKS = ("\n", ". ", "! ", "? ", "; ")


def overlap_chunks(text: str, size: int = 512, overlap: int = 50) -> list[tuple[int, int]]:
    """[start, end) of chunks: each ends after the last soft break past its half, the next starts `overlap` before."""
    out, pos = [], 0
    while pos < len(text):
        end = min(pos + size, len(text))
        if end < len(text):
            at = max(text.rfind(b, pos + size // 2, end) + len(b) for b in BREAKS if text.rfind(b, pos + size // 2, end) >= 0) if any(text.rfind(b, pos + size // 2, end) >= 0 for b in BREAKS) else end
            end = at
        out.append((pos, end))
        if end == len(text):
            break
        pos = max(end - overlap, pos + 1)
    return out


def sentence_chunks(text: str, size: int = 512, overlap: int = 50) -> list[str]:
    """Sentences packed up to `size` characters; up to `overlap` characters of trailing sentences are carried on."""
    import re

    sentences = [s for s in re.split(r"(?<=[.!?。！？])\s+", text.strip()) if s]
    out: list[str] = []
    held: list[str] = []
    for s in sentences:
        if held and len(" ".join([*held, s])) > size:
            out.append(" ".join(held))
            kept: list[str] = []
            for x in reversed(held):
                if len(" ".join([x, *kept])) > overlap:
                    break
                kept.insert(0, x)
            held = kept
        held.append(s)
    if held:
        out.append(" ".join(held))
    return out


#: Characters of texts whose chunks go out together.
CHUNKED_CHARS = 1 << 20


def _chunked(df: DataFrame, id: str, text: str, cut, columns: str) -> DataFrame:
    names = [id, "chunk_index", *[x.split()[0] for x in columns.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, held = [], 0
            for i, t in zip(pdf[id], pdf[text], strict=True):
                rows += [(i, k, *c) for k, c in enumerate(cut(t or ""))]
                held += len(t or "")
                if held >= CHUNKED_CHARS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return df.select(id, text).mapInPandas(run, f"`{id}` {df.schema[id].dataType.simpleString()}, chunk_index int, {columns}")


def chunk_overlap(df: DataFrame, id: str, text: str, size: int = 512, overlap: int = 50) -> DataFrame:
    return _chunked(df, id, text, lambda t: [(t[a:b], a, b) for a, b in overlap_chunks(t, size, overlap)], "chunk string, start_pos int, end_pos int")


def chunk_sentences(df: DataFrame, id: str, text: str, size: int = 512, overlap: int = 50) -> DataFrame:
    return _chunked(df, id, text, lambda t: [(c,) for c in sentence_chunks(t, size, overlap)], "chunk string")


def extract_memories(conversations: DataFrame, indicators: dict[str, list[str]], common: list[str] = ()) -> DataFrame:
    """conv_id, turn, memory_type, content: sentences of user turns that hold an indicator (facts also a capitalised
    word), and of other turns code blocks and lists of three items or more. Common phrases and under three words go."""
    users = conversations.where("role = 'user'")
    s = users.select("conv_id", "turn", F.explode(F.split("text", r"[.!?]+")).alias("s"))
    s = s.withColumn("content", F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace("s", r"\s+", " ")), r"[^\w\s.,!?'-]", ""), r"\s+$", ""))
    s = s.where((F.size(F.split("content", " ")) >= 3) & ~F.lower("content").isin(list(common) or [""]))
    hit = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower("s"), w))
    parts = []
    for kind, words in indicators.items():
        cond = hit(words)
        parts.append(F.when(cond & F.col("content").rlike(r"\b[A-Z][a-z]+") if kind == "fact" else cond, kind))
    kinds = F.filter(F.array(*parts), lambda x: x.isNotNull())
    said = s.select("conv_id", "turn", F.explode(kinds).alias("memory_type"), "content")
    other = conversations.where("role <> 'user'")
    code = other.select("conv_id", "turn", F.lit("code").alias("memory_type"), F.explode(F.regexp_extract_all("text", F.lit(r"(```[\s\S]*?```)"), F.lit(1))).alias("content"))
    items = F.regexp_extract_all("text", F.lit(r"(?m)^\s*([-*•]\s+.+)$"), F.lit(1))
    lists = other.where(F.size(items) >= 3).select("conv_id", "turn", F.lit("list").alias("memory_type"), F.array_join(F.slice(items, 1, 3), "; ").alias("content"))
    return said.unionByName(code).unionByName(lists)
