"""Typing, cleaning and masking expressions: per row, no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss")


def parse_date_multi(col: Column | str, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first of the formats that reads the whole text, else null."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(col), F.lit(f)) for f in formats]).cast("date")


def type_by_name(df: DataFrame, date_kw: list[str], numeric_kw: list[str], string_kw: list[str]) -> DataFrame:
    """Types all-string columns by words in their names: string words win, then date, then numeric; bad values are null."""

    def typed(name: str) -> Column:
        low = name.lower()
        if any(k in low for k in string_kw):
            return F.col(name)
        if any(k in low for k in date_kw):
            return parse_date_multi(name).alias(name)
        if any(k in low for k in numeric_kw):
            return F.col(name).try_cast("double").alias(name)
        return F.col(name)

    return df.select(*[typed(c) for c in df.columns])


def epoch_to_ts(col: Column | str) -> Column:
    """Epoch in microseconds above 1e15, milliseconds above 1e12, else seconds; null and 0 are null."""
    c = F.col(col) if isinstance(col, str) else col
    micros = F.when(c > 10**15, c).when(c > 10**12, c * 1000).otherwise(c * 1_000_000)
    return F.when(c.isNotNull() & (c != 0), F.timestamp_micros(micros.cast("long")))


def clean_rows(df: DataFrame) -> DataFrame:
    """Strings trimmed, empty ones null, and rows without any value dropped."""
    strings = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    trimmed = df.select(*[F.nullif(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit("")).alias(c) if c in strings else F.col(c) for c in df.columns])
    return trimmed.dropna("all")


def flatten_nested(df: DataFrame) -> DataFrame:
    """Structs become their `value`, else `name`, else `uuid`, else JSON; arrays of any kind become joined text."""

    def one(col: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            named = next((n for n in ("value", "name", "uuid") if n in kind.names), None)
            return col[named].cast("string") if named else F.to_json(col)
        return col.cast("string")

    def flat(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.ArrayType):
            return F.array_join(F.transform(f.name, lambda x: one(x, f.dataType.elementType)), ",").alias(f.name)
        return one(F.col(f.name), f.dataType).alias(f.name) if isinstance(f.dataType, T.StructType) else F.col(f.name)

    return df.select(*[flat(f) for f in df.schema])


def extract_code(col: Column | str, pattern: str) -> Column:
    """First group of the pattern; the text itself where it doesn't match, '' for null."""
    c = F.coalesce(col, F.lit(""))
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1)).otherwise(c)


def mask_name(col: Column | str, mark: str = "**") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.length(c) < 2, c).otherwise(F.concat(F.substring(c, 1, 1), F.lit(mark)))


def mask_phone(col: Column | str) -> Column:
    """Digits only; of eleven the first three and last four stay."""
    digits = F.regexp_replace(col, r"[^0-9]", "")
    return F.when(F.length(digits) == 11, F.concat(F.substring(digits, 1, 3), F.lit("****"), F.substring(digits, 8, 4))).otherwise(digits)


def mask_mail(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    user, domain = F.split_part(c, F.lit("@"), F.lit(1)), F.split_part(c, F.lit("@"), F.lit(2))
    hidden = F.when(F.length(user) > 3, F.concat(F.substring(user, 1, 3), F.lit("***@"), domain)).otherwise(F.concat(F.lit("***@"), domain))
    return F.when(c.contains("@"), hidden).otherwise(c)


MASKS = {"name": mask_name, "phone": mask_phone, "mail": mask_mail}


def mask_pii(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Masks columns whose lower-cased name contains a rule's word: word -> name, phone or mail."""
    kind = {c: next((k for word, k in rules.items() if word in c.lower()), None) for c in df.columns}
    return df.select(*[MASKS[k](c).alias(c) if k else F.col(c) for c, k in kind.items()])


def jitter(df: DataFrame, words: list[str], seed: int, low: float = 0.9, high: float = 1.1) -> DataFrame:
    """Numbers of columns whose name contains a sensitive word, times a random factor."""
    hit = [c for c in df.columns if any(w in c.lower() for w in words)]
    return df.withColumns({c: F.col(c) * (F.rand(seed + i) * (high - low) + low) for i, c in enumerate(hit)})


def estimate_tokens(col: Column | str) -> Column:
    """Ideographs / 1.3 + other characters / 2, cut to a whole number, + 1; 0 for empty text."""
    c = F.coalesce(col, F.lit(""))
    ideographs = F.length(F.regexp_replace(c, "[^一-鿿]", ""))
    return F.when(c == "", 0).otherwise(F.floor(ideographs / 1.3 + (F.length(c) - ideographs) / 2) + 1).cast("long")


def _replace_all(col: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, col)


def clean_text(col: Column | str, corrections: list[tuple[str, str]] = (), level: str = "standard") -> Column:
    """Cleans noisy text. basic: literal replacements, then lines under three characters go. standard: also lines of a
    page number, runs of one noise symbol and spaces. full: also runs of blanks between words of four or more letters
    of one kind are left as they are, and blank edges go."""
    c = _replace_all(F.col(col) if isinstance(col, str) else col, list(corrections))
    lines = F.filter(F.split(c, "\n"), lambda x: F.length(F.trim(x)) >= 3)
    if level == "basic":
        return F.array_join(lines, "\n")
    lines = F.filter(lines, lambda x: ~(F.trim(x).rlike(r"^[0-9\s.\-]+$") & (F.length(F.trim(x)) <= 10)))
    text = F.array_join(lines, "\n")
    for run in (r"[|]{4,}", r"[:]{4,}", r"[=]{4,}", r"[-]{5,}", r"[.]{5,}"):
        text = F.regexp_replace(text, run, " ")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return text if level == "standard" else F.trim(F.regexp_replace(text, r"\n{2,}", "\n"))


SENTENCE_END = r"[.!?;:。；：？！）】》]$"
SENTENCE_START = r"^([第零一二三四五六七八九十0-9]+[条款项.、]|[0-9]+\.)"


def merge_broken_lines(col: Column | str, end: str = SENTENCE_END, start: str = SENTENCE_START, heading: str = r"^#", gap: str = "") -> Column:
    """Joins a line to the open sentence unless that has ended, or the line starts a new one, is a heading or blank."""
    lines = F.transform(F.split(col, "\n"), lambda x: F.trim(x))
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    push = lambda done, s: F.when(s != "", F.concat(done, F.array(s))).otherwise(done)

    def step(acc: Column, line: Column) -> Column:
        done, held = acc["done"], acc["open"]
        closes = held.rlike(end) | line.rlike(start)
        new_done = F.when(line == "", push(done, held)).when(line.rlike(heading), F.concat(push(done, held), F.array(line))).when((held != "") & ~closes, done).otherwise(push(done, held))
        new_open = F.when((line == "") | line.rlike(heading), F.lit("")).when((held != "") & ~closes, F.concat(held, F.lit(gap), line)).otherwise(line)
        return F.struct(new_done.alias("done"), new_open.alias("open"))

    return F.aggregate(lines, empty, step, lambda acc: F.array_join(push(acc["done"], acc["open"]), "\n"))


# Characters that count as garbage and as table borders.
GARBAGE = "[─│┌┐└┘├┤┬┴┼╔╗╚╝═║■□▪▫●○◆◇★☆@®©™]"
BORDER = "[─│┌┐└┘├┤┬┴┼╔╗╚╝═║]"
#: The same behind a range that most characters are outside of, so that they aren't compared with each one.
_GARBAGE, _BORDER = rf"[@©®[\u2122-\u2606&&{GARBAGE}]]", rf"[\u2500-\u257f&&{BORDER}]"


def text_quality(df: DataFrame, text: str, noise_words: list[str] = ()) -> DataFrame:
    """Adds char_ratio, noise_level (1-5), coherence, quality (0-100) and quality_name of a text column.

    Characters outside letters, digits, punctuation and white space count as invalid; lines' lengths make the coherence.
    """
    c = F.coalesce(F.col(text), F.lit(""))
    n = F.length(F.regexp_replace(c, r"\s+", ""))
    garbage = F.regexp_count(c, F.lit(_GARBAGE))
    invalid = F.regexp_count(c, F.lit(r"[^\x21-\x7e\s\p{L}\p{N}\p{P}\p{S}\p{M}]"))
    valid = n - garbage - invalid
    ratio = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), valid / n * (1 - garbage / n * 0.5))))
    lines = F.split(c, "\n")
    words = sum((F.regexp_count(c, F.lit(w)) for w in noise_words), F.lit(0))
    borders = F.regexp_count(c, F.lit(_BORDER))
    short = F.size(F.filter(lines, lambda x: F.length(F.trim(x)) < 3)) / F.size(lines)
    blank = F.size(F.filter(lines, lambda x: F.length(F.trim(x)) == 0)) / F.size(lines)
    score = F.least(words, F.lit(3)) + F.when(borders > 20, F.least(F.floor(borders / 20), F.lit(2))).otherwise(0) + F.when(short > 0.4, 1).otherwise(0) + F.when(blank > 0.5, 1).otherwise(0)
    noise = F.when(c == "", 5).otherwise(F.least(F.floor(score / 2) + 1, F.lit(5))).cast("int")
    sizes = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(F.trim(x)).cast("double"))
    total = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x * x)
    k = F.size(sizes)
    mean = total / k
    deviation = F.sqrt(F.greatest(F.lit(0.0), squares / k - mean * mean))
    coherence = F.when(k < 3, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - deviation / F.greatest(mean, F.lit(1.0))) * 0.6 + 0.4)
    out = df.withColumns({"char_ratio": ratio, "noise_level": noise, "coherence": coherence})
    quality = (F.col("char_ratio") * 100 + (5 - F.col("noise_level")) * 25 + F.col("coherence") * 100) / 3
    out = out.withColumn("quality", quality)
    return out.withColumn("quality_name", F.when(F.col("quality") >= 90, "excellent").when(F.col("quality") >= 75, "good").when(F.col("quality") >= 60, "fair").otherwise("poor"))
