"""Tables in plain text: with pipes, with box-drawing borders, or with columns set by spaces. DataFrame functions inside the
row: no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of borders, and of letters that take two columns.
CORNERS = "┌┐└┘╔╗╚╝"
JUNCTIONS = "├┤┬┴┼"
VERTICAL = "│║|"
HORIZONTAL = "─═-"
BOX = "─│┌┐└┘├┤┬┴┼"
WIDE = "\u1100-\u115f\u2e80-\ua4cf\uac00-\ud7a3\uf900-\ufaff\ufe30-\ufe6f\uff00-\uff60\uffe0-\uffe6"

_BORDERS = f"{CORNERS}{JUNCTIONS}{VERTICAL}{HORIZONTAL.replace('-', '')}-"
_FILL, _BLANK, _CUT = "\uffff", "\x02", "\x03"


def _count(x: Column, chars: str) -> Column:
    """How often any of the characters (a regex class without brackets) occurs."""
    return F.length(x) - F.length(F.regexp_replace(x, f"[{chars}]+", ""))


def _parts(x: Column) -> Column:
    return F.split(F.btrim(x), r"\s{2,}")


def is_table_line(x: Column) -> Column:
    """Three border characters; or three pipes, of which one begins and one ends the line; or three parts apart by two
    spaces or more."""
    t = F.btrim(x, F.lit(" \t\r"))
    spaced = F.size(F.filter(_parts(x), lambda p: p != "")) >= 3
    return (_count(x, BOX) >= 3) | ((_count(x, "|") >= 3) & t.startswith("|") & t.endswith("|")) | (x.contains("  ") & spaced)


def table_regions(df: DataFrame, id: str, text: str, gap: int = 3) -> DataFrame:
    """id, region (from 1), first (line number from 0), lines: from a table line to the last one that lies no more than
    `gap` lines after the one before; the lines between are kept."""
    lines = df.select(id, F.split(text, "\n", -1).alias("_l"))
    at = lines.withColumn("_at", F.filter(F.transform("_l", lambda x, i: F.when(is_table_line(x), i)), lambda i: i.isNotNull()))
    edge = lambda step: lambda x, i: F.coalesce((F.get("_at", i + step) - x) * step > gap, F.lit(True))
    found = at.withColumn("_r", F.arrays_zip(F.filter("_at", edge(-1)).alias("a"), F.filter("_at", edge(1)).alias("b")))
    each = found.select(id, "_l", F.posexplode("_r").alias("_n", "_r"))
    return each.select(id, (F.col("_n") + 1).alias("region"), F.col("_r.a").alias("first"), F.slice("_l", F.col("_r.a") + 1, F.col("_r.b") - F.col("_r.a") + 1).alias("lines"))


def _columns(cells: Column) -> Column:
    return F.array_max(F.transform(cells, lambda r: F.size(r)))


def _row(cells: Column, role: Column) -> Column:
    return F.struct(cells.alias("cells"), role.alias("role"))


_SEPARATOR = r"^\s*\|?[\s:\-|]+\|?\s*$"


def _separates(x: Column) -> Column:
    return x.rlike(_SEPARATOR) & x.contains("---")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once, also where body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def _places(lines: Column, hit: Callable[[Column, Column], Column]) -> Column:
    """Numbers of the lines that hit(line, number) holds for."""
    return F.filter(F.transform(lines, lambda x, i: F.when(hit(x, i), i)), lambda i: i.isNotNull())


def _pipe_rows(lines: Column) -> Column:
    """Rows from the first to the last line with two pipes, if there is a separator line after the first one; else null."""
    cells = lambda x: F.transform(F.split(F.regexp_replace(F.btrim(x), r"^\||\|$", ""), r"\|", -1), lambda c: F.btrim(c))
    role = lambda i, at: F.when(i < at, "header").when(i == at, "separator").otherwise("data")
    rows = lambda full: lambda at: F.when(at.isNotNull(), F.transform(full, lambda x, i: _row(cells(x), role(i, at))))
    first = lambda full: F.array_min(_places(full, lambda x, i: (i > 0) & _separates(x) & (_count(x, "|") >= 2)))
    inner = lambda piped: F.filter(F.slice(lines, F.array_min(piped) + 1, F.array_max(piped) - F.array_min(piped) + 1), lambda x: F.btrim(x) != "")
    inside = lambda piped: F.when(F.size(piped) >= 2, _let(inner(piped), lambda full: _let(first(full), rows(full))))
    return _let(_places(lines, lambda x, i: _count(x, "|") >= 2), inside)


def _border_rows(lines: Column, least: int) -> Column:
    """Rows of the lines with `least` characters between borders, if any line has two corners or ten rules; cells lie
    between vertical lines. The rows above the first inner rule are the header."""
    bordered = F.exists(lines, lambda x: (_count(x, CORNERS) >= 2) | (_count(x, HORIZONTAL) >= 10))
    inside = lambda x: F.length(F.regexp_replace(x, rf"[\s{_BORDERS}]+", ""))
    trimmed = lambda x: F.regexp_replace(F.btrim(x), f"^[{VERTICAL}]|[{VERTICAL}]$", "")
    cells = lambda x: F.transform(F.split(trimmed(x), f"[{VERTICAL}]", -1), lambda c: F.btrim(F.regexp_replace(c, rf"[\s{CORNERS}{JUNCTIONS}─═]+", " ")))

    def rows(content: Column) -> Column:
        rules = lambda ends: F.array_min(_places(lines, lambda x, i: (i > ends["a"]) & (i < ends["b"]) & (inside(x) == 0) & (_count(x, HORIZONTAL) >= 2)))
        inner = _let(F.struct(F.array_min(content).alias("a"), F.array_max(content).alias("b")), rules)
        return _let(inner, lambda rule: F.transform(content, lambda i: _row(cells(F.get(lines, i)), F.when(i < rule, "header").otherwise("data"))))

    return F.when(bordered, _let(_places(lines, lambda x, i: inside(x) >= least), lambda content: F.when(F.size(content) > 0, rows(content))))


def _blank_runs(x: Column, width: Column) -> Column:
    """Per column of the page 1 where the line has a blank of a run of two or more, begins with blanks or has ended."""
    marked = F.regexp_replace(F.regexp_replace(x, "(?<= ) | (?= )|^ ", _BLANK), f"[^{_BLANK}]", "0")
    return F.split(F.rpad(F.replace(marked, F.lit(_BLANK), F.lit("1")), width, F.lit("1")), "")


def _space_rows(lines: Column) -> Column:
    """Rows of columns that spaces keep apart.

    A column's edge is a run of page columns that are blank in every line: the intersection of the lines' blank runs of
    two or more. So a missing cell leaves its place empty. Where no edges come out (ragged lines), lines are split at two
    spaces, if their numbers of parts differ by one at most; else null. Wide letters take two columns.
    """
    plain = lambda x: F.regexp_replace(F.rtrim(F.regexp_replace(x, "\t", "    ")), f"([{WIDE}])", f"$1{_FILL}")
    clean = lambda c: F.btrim(F.replace(c, F.lit(_FILL), F.lit("")))
    both = lambda acc, x: F.zip_with(acc, x, lambda a, b: F.least(a, b))
    common = lambda full, width: F.aggregate(F.transform(full, lambda x: _blank_runs(x, width)), F.array_repeat(F.lit("1"), width), both)
    marked = lambda x, width, edges: F.array_join(F.zip_with(F.split(F.rpad(x, width, F.lit(" ")), ""), edges, lambda c, m: F.when(m == "1", _CUT).otherwise(c)), "")
    cut = lambda x, width, edges: F.transform(F.split(F.regexp_replace(marked(x, width, edges), f"^{_CUT}+|{_CUT}+$", ""), f"{_CUT}+", -1), clean)
    edged = lambda full: _let(F.array_max(F.transform(full, lambda x: F.length(x))), lambda width: _let(common(full, width), lambda edges: F.transform(full, lambda x: cut(x, width, edges))))
    split = lambda full: F.transform(full, lambda x: F.transform(F.filter(_parts(x), lambda p: p != ""), clean))

    def chosen(by_edge: Column, by_space: Column) -> Column:
        sizes = F.transform(by_space, lambda r: F.size(r))
        whole = ~F.exists(by_edge, lambda r: F.exists(r, lambda c: c.contains("  ")))  # no cell spans what a line itself keeps apart
        aligned = (_columns(by_edge) >= F.array_max(sizes)) & whole
        ragged = F.array_max(sizes) - F.array_min(sizes) <= 1
        return F.when(F.array_max(sizes) > 1, F.when(aligned, by_edge).when(ragged, by_space))

    rows = lambda full: _let(edged(full), lambda e: _let(split(full), lambda x: chosen(e, x)))
    named = lambda found: F.transform(found, lambda r, i: _row(r, F.when(i == 0, "header").otherwise("data")))
    return _let(F.transform(F.filter(lines, lambda x: F.btrim(x) != ""), plain), lambda full: F.when(F.size(full) >= 2, _let(rows(full), named)))


def detect_tables(df: DataFrame, id: str, text: str, gap: int = 3, least_content: int = 4) -> DataFrame:
    """id, table_no, kind, n_cols, row_no, role, cell_no, cell of the tables of a text.

    kind is 'pipe' (with a separator line), 'border' or 'space', the first of them that a region of table lines parses as;
    regions of none aren't tables. Short rows are filled up with empty cells. role: header, separator or data (a space
    table's first row is its header). Null and empty texts have no tables.
    """
    regions = table_regions(df, id, text, gap)
    kinds = (("pipe", _pipe_rows(F.col("lines"))), ("border", _border_rows(F.col("lines"), least_content)), ("space", _space_rows(F.col("lines"))))
    named = lambda kind: lambda r: F.when(r.isNotNull(), F.struct(F.lit(kind).alias("kind"), r.alias("rows")))
    parsed = F.coalesce(*[_let(rows, named(kind)) for kind, rows in kinds])
    found = regions.select(id, "region", parsed.alias("_p")).where("_p IS NOT NULL").select(id, "region", "_p.kind", F.col("_p.rows").alias("_rows"))
    found = found.withColumn("n_cols", _columns(F.transform("_rows", lambda r: r["cells"])))
    row = found.select(id, F.col("region").alias("table_no"), "kind", "n_cols", F.posexplode("_rows").alias("_i", "_row"))
    filled = F.concat(F.col("_row.cells"), F.array_repeat(F.lit(""), F.col("n_cols") - F.size("_row.cells")))
    cells = row.select(id, "table_no", "kind", "n_cols", (F.col("_i") + 1).alias("row_no"), F.col("_row.role").alias("role"), F.posexplode(filled).alias("cell_no", "cell"))
    return cells
