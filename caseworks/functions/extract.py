"""Metadata, importance, snippets and fields of a text, by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word edges by ASCII letters, digits and underscore, alike in every Java release.
EDGE_LEFT, EDGE_RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
# Tags by the pattern that gives them.
TAGS = {
    "code": "```",
    "programming": f"(?i){EDGE_LEFT}(python|javascript|typescript|java|rust|go){EDGE_RIGHT}",
    "api": f"(?i){EDGE_LEFT}(api|endpoint|request|response){EDGE_RIGHT}",
}


def entities(text: Column | str, n: int = 5) -> Column:
    """Distinct capitalised words or phrases, the first n."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"{EDGE_LEFT}([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*){EDGE_RIGHT}"), F.lit(1))), 1, n)


def text_metadata(df: DataFrame, id: str, text: str, n: int = 5, common: list[str] = ()) -> DataFrame:
    """id, entities, keywords (most frequent words of four letters or more, ties by alphabet), tags."""
    words = F.filter(F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"{EDGE_LEFT}([a-z]{{4,}}){EDGE_RIGHT}"), F.lit(1)), lambda w: ~w.isin(list(common) or [""]))
    tags = F.filter(F.array(*[F.when(F.col(text).rlike(p), t) for t, p in TAGS.items()]), lambda x: x.isNotNull())
    base = df.select(id, entities(text, n).alias("entities"), tags.alias("tags"), words.alias("_w"))
    again = df.where(F.col(id).isNotNull()).groupBy(id).agg(F.count("*").alias("_c")).where("_c > 1").select(id)
    none = F.array().cast("array<string>")
    if again.isEmpty():  # a row is all of its id, so nothing is shuffled
        return base.select(id, "entities", F.when(F.col(id).isNotNull(), F.coalesce(_most_frequent(F.col("_w"), n), none)).otherwise(none).alias("keywords"), "tags")
    counted = df.select(id, F.explode(words).alias("w")).groupBy(id, "w").agg(F.count("*").alias("c"))
    top = counted.groupBy(id).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "w"))), 1, n).alias("k")).select(id, F.col("k.w").alias("keywords"))
    return base.drop("_w").join(top, id, "left").select(id, "entities", F.coalesce("keywords", none).alias("keywords"), "tags")


def _most_frequent(words: Column, n: int) -> Column:
    """The n most frequent of an array of words, ties by alphabet: runs of equal words in their order, by length."""
    bound = lambda x, body: F.get(F.transform(F.array(x), body), 0)  # noqa: E731  x is worked out once
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda s: bound(starts(s), lambda at: F.transform(at, lambda i, k: F.struct((i - F.coalesce(F.get(at, k + 1), F.size(s))).alias("c"), F.get(s, i).alias("w"))))
    return F.when(F.size(words) > 0, F.transform(F.slice(F.sort_array(bound(F.sort_array(words), runs)), 1, n), lambda x: x["w"]))


def is_common(content: Column | str, common: list[str] = ()) -> Column:
    c = F.lower(F.trim(content))
    return c.isin(list(common) or [""]) | (F.size(F.split(c, " ")) < 3)


def importance(type: Column | str, content: Column | str, n_entities: Column, n_keywords: Column, common: list[str] = ()) -> Column:
    """0.5, more for facts (0.2), preferences and patterns (0.3), entities and keywords; less for common phrases; 0 to 1."""
    t = F.col(type) if isinstance(type, str) else type
    score = 0.5 + F.when(t == "fact", 0.2).when(t.isin("preference", "pattern"), 0.3).otherwise(0.0)
    score = score - F.when(is_common(content, common), 0.2).otherwise(0.0) + 0.1 * F.least(n_entities, F.lit(3)) + 0.05 * F.least(n_keywords, F.lit(2))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def snippet(col: Column | str, keyword: str, before: int = 100, after: int = 300) -> Column:
    """Text around the first hit in any case; null without one."""
    c = F.col(col) if isinstance(col, str) else col
    at = F.locate(keyword.lower(), F.lower(c))
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(c, start, at + after - start))


def extract_fields(df: DataFrame, text: str, field_rules: list[tuple[str, str]], max_chars: int = 2000, default: str = "") -> DataFrame:
    """Adds a column per field: groups of the first of its patterns that matches within max_chars, joined by a space;
    values of two characters or fewer are the default."""
    head = F.substring(F.col(text), F.lit(1), F.lit(max_chars))
    fields: dict[str, list[str]] = {}
    for name, pattern in field_rules:
        fields.setdefault(name, []).append(pattern)
    import re

    def value(pattern: str) -> Column:
        n = re.compile(pattern).groups
        groups = [F.nullif(F.regexp_extract(head, pattern, i), F.lit("")) for i in range(1, n + 1)] or [F.regexp_extract(head, pattern, 0)]
        v = F.trim(F.concat_ws(" ", *groups))
        return F.when(F.length(v) > 2, v)

    return df.withColumns({k: F.coalesce(*[value(p) for p in ps], F.lit(default)) for k, ps in fields.items()})


def extract_typed_fields(df: DataFrame, text: str, field_rules: list[tuple[str, str, int]]) -> DataFrame:
    """Adds `fields`: a map from field to (value, confidence) of the first match of each rule (field, pattern, confidence)."""
    entry = [F.struct(F.lit(f).alias("key"), F.struct(F.regexp_extract(text, p, 1).alias("value"), F.lit(c).alias("confidence")).alias("value")) for f, p, c in field_rules]
    return df.withColumn("fields", F.map_from_entries(F.filter(F.array(*entry), lambda e: e["value"]["value"] != "")))
