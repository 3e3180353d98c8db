"""Queries of text splitting, extraction and rule tables on documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseworks.functions import extract
from caseworks.operators import rules, stats, tables, textsplit
from caseworks.plans.registry import query, table

_START_RE = "^(The|And|Of|Die|Der|De|La|Le|El|Un)[ ,.]"
CLAUSES_SQL = r"""ln AS (SELECT doc_id, i, trim(l, ' ') AS l FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE length(trim(l, ' ')) >= 3),
gr AS (SELECT *, sum(CASE WHEN regexp_matches(l, '^(The|And|Of|Die|Der|De|La|Le|El|Un)[ ,.]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM ln),
cl AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g))::INTEGER AS clause_no, content, length(content)::INTEGER AS length FROM (SELECT doc_id, g, string_agg(l, chr(10) ORDER BY i) AS content FROM gr GROUP BY 1, 2))"""


def clauses(spark, d):
    return textsplit.split_clauses(table(spark, d, "documents"), "doc_id", "text", [_START_RE])


def categories(spark):
    return spark.createDataFrame([(1, "scope", ["thther", "onerstan"]), (2, "payment", ["ntion", "eaux"]), (3, "term", ["keit", "ción", "ing "])], "seq int, name string, keywords array<string>")


def tiers(spark):
    return spark.createDataFrame([(1, "high", ["onthe", "queeux"]), (2, "medium", ["hethe", "tiontion", "schge"]), (3, "low", ["erer", "ouou"])], "tier int, level string, keywords array<string>")


CAT_SQL = "CASE WHEN contains(content, 'thther') OR contains(content, 'onerstan') THEN 'scope' WHEN contains(content, 'ntion') OR contains(content, 'eaux') THEN 'payment' WHEN contains(content, 'keit') OR contains(content, 'ción') OR contains(content, 'ing ') THEN 'term' ELSE 'other' END"
TIER_SQL = "CASE WHEN contains(lower(content), 'onthe') OR contains(lower(content), 'queeux') THEN 'high' WHEN contains(lower(content), 'hethe') OR contains(lower(content), 'tiontion') OR contains(lower(content), 'schge') THEN 'medium' WHEN contains(lower(content), 'erer') OR contains(lower(content), 'ouou') THEN 'low' ELSE 'none' END"


@query("t1_split_clauses", f"WITH {CLAUSES_SQL} SELECT doc_id, clause_no, md5(content) AS content, length FROM cl")
def t1(spark, d):
    return clauses(spark, d).withColumn("content", F.md5("content"))


@query(
    "t2_extract_items",
    r"""WITH ln AS (SELECT doc_id, i, trim(l, ' ') AS l FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE length(trim(l, ' ')) >= 3),
    gr AS (SELECT *, sum(CASE WHEN regexp_matches(l, '^(?:The ([a-z]+))') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM ln),
    s AS (SELECT doc_id, g, min(g) OVER (PARTITION BY doc_id) AS g0, string_agg(l, chr(10) ORDER BY i) AS c FROM gr GROUP BY doc_id, g)
    SELECT doc_id, (g - g0)::INTEGER AS item_no, regexp_extract(c, 'The ([a-z]+)', 1) AS name, list_extract(regexp_extract_all(c, ' (of [a-z]+)', 1), -1) AS amount, list_extract(regexp_extract_all(c, '([0-9]+)', 1), -1) AS quantity FROM s WHERE g > 0""",
)
def t2(spark, d):
    return textsplit.extract_items(table(spark, d, "documents"), "doc_id", "text", r"The ([a-z]+)", {"amount": r" (of [a-z]+)", "quantity": r"([0-9]+)"})


@query(
    "t3_extract_tables",
    r"""WITH ln AS (SELECT doc_id, i, l FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE contains(l, '|')),
    n AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 3 THEN 0 ELSE 1 END AS nw FROM ln), t AS (SELECT *, (sum(nw) OVER (PARTITION BY doc_id ORDER BY i))::INTEGER AS table_no FROM n),
    r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, table_no ORDER BY i))::INTEGER AS row_no, string_split(regexp_replace(trim(l, ' '), '^\||\|$', '', 'g'), '|') AS c FROM t)
    SELECT doc_id, table_no, row_no, unnest(range(len(c)))::INTEGER AS cell_no, trim(unnest(c), ' ') AS cell FROM r""",
)
def t3(spark, d):
    return textsplit.extract_tables(table(spark, d, "documents"), "doc_id", "text")


# Pages of 25 parts, printed as tables: every seventh part has no brand, and names hold single spaces.
_PAGES = """WITH p AS (SELECT p_partkey // 25 AS page, p_partkey, [p_name, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END, p_size::VARCHAR, p_type] AS cells FROM part),
    r AS (SELECT page, 0 AS p_partkey, ['name', 'brand', 'size', 'type'] AS cells, 1 AS row_no FROM (SELECT DISTINCT page FROM p) UNION ALL SELECT page, p_partkey, cells, 1 + row_number() OVER (PARTITION BY page ORDER BY p_partkey) FROM p)"""
_CELLS = "SELECT page, 1 AS table_no, '{kind}' AS kind, 4 AS n_cols, row_no::INTEGER AS row_no, CASE WHEN row_no = 1 THEN 'header' ELSE 'data' END AS role, unnest(range(4))::INTEGER AS cell_no, unnest(cells) AS cell FROM r"


def _pages(spark, d, line, head, foot):
    """(page, text): text, a table of a page's parts and text again."""
    p = table(spark, d, "part").withColumn("brand", F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_brand")))
    of = [F.lit("name"), F.lit("brand"), F.lit("size"), F.lit("type")]
    own = line(F.col("p_name"), F.col("brand"), F.col("p_size").cast("string"), F.col("p_type"))
    rows = p.groupBy((F.col("p_partkey") / 25).cast("long").alias("page")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", own.alias("line")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return rows.select("page", F.concat(F.lit("Parts of this page.\nSee below.\n\n\n\n"), head(line(*of)), body, foot, F.lit("\n\n\n\nEnd of the page.")).alias("text"))


@query("t3_space_tables", f"{_PAGES} {_CELLS.format(kind='space')}")
def t3_space(spark, d):
    line = lambda name, brand, size, kind: F.concat(F.rpad(name, 30, " "), F.rpad(brand, 12, " "), F.lpad(size, 4, " "), F.lit("   "), kind)
    return tables.detect_tables(_pages(spark, d, line, lambda x: F.concat(x, F.lit("\n")), F.lit("")), "page", "text")


@query("t3_border_tables", f"{_PAGES} {_CELLS.format(kind='border')}")
def t3_border(spark, d):
    line = lambda name, brand, size, kind: F.concat(F.lit("│ "), F.rpad(name, 30, " "), F.lit("│"), F.rpad(brand, 12, " "), F.lit("│ "), size, F.lit(" │"), kind, F.lit("│"))
    rule = lambda a, b, c: a + b.join("─" * n for n in (31, 12, 6, 8)) + c
    head = lambda x: F.concat(F.lit(rule("┌", "┬", "┐") + "\n"), x, F.lit("\n" + rule("├", "┼", "┤") + "\n"))
    return tables.detect_tables(_pages(spark, d, line, head, F.lit("\n" + rule("└", "┴", "┘"))), "page", "text")


@query("t4_chunk_fixed", "SELECT doc_id, i::INTEGER AS chunk_index, md5(substr(text, i * 1000 + 1, 1000)) AS chunk FROM (SELECT doc_id, text, unnest(range(ceil(length(text) / 1000)::BIGINT)) AS i FROM documents WHERE length(text) > 0)")
def t4(spark, d):
    return textsplit.chunk_fixed(table(spark, d, "documents"), "doc_id", "text").withColumn("chunk", F.md5("chunk"))


@query("t5_chunk_overlap")
def t5(spark, d):
    return textsplit.chunk_overlap(table(spark, d, "documents"), "doc_id", "text")


@query("t6_chunk_sentences")
def t6(spark, d):
    return textsplit.chunk_sentences(table(spark, d, "documents"), "doc_id", "text")


INDICATORS = {"preference": ["thon", "eaux"], "fact": ["ing", "tion"], "pattern": ["onon"]}


@query(
    "t7_extract_memories",
    r"""WITH s AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[.!?]+')) AS s FROM conversations WHERE role = 'user'),
    c AS (SELECT conv_id, turn, s, regexp_replace(regexp_replace(trim(regexp_replace(s, '\s+', ' ', 'g'), ' '), '[^\w\s.,!?''-]', '', 'g'), '\s+$', '') AS content FROM s),
    k AS (SELECT * FROM c WHERE len(string_split(content, ' ')) >= 3),
    a AS (SELECT conv_id, turn, 'preference' AS memory_type, content FROM k WHERE contains(lower(s), 'thon') OR contains(lower(s), 'eaux')
      UNION ALL SELECT conv_id, turn, 'fact', content FROM k WHERE (contains(lower(s), 'ing') OR contains(lower(s), 'tion')) AND regexp_matches(content, '\b[A-Z][a-z]+')
      UNION ALL SELECT conv_id, turn, 'pattern', content FROM k WHERE contains(lower(s), 'onon')),
    o AS (SELECT conv_id, turn, regexp_extract_all(text, '(```(?s:.)*?```)', 1) AS code, regexp_extract_all(text, '(?m)^\s*([-*•]\s+.+)$', 1) AS items FROM conversations WHERE role <> 'user')
    SELECT * FROM a UNION ALL SELECT conv_id, turn, 'code', unnest(code) FROM o UNION ALL SELECT conv_id, turn, 'list', array_to_string(items[1:3], '; ') FROM o WHERE len(items) >= 3""",
)
def t7(spark, d):
    return textsplit.extract_memories(table(spark, d, "conversations"), INDICATORS)


@query(
    "p19_text_metadata",
    r"""WITH w AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\b([a-z]{4,})\b', 1)) AS w FROM documents) GROUP BY 1, 2),
    k AS (SELECT doc_id, list(w ORDER BY -c, w)[1:5] AS keywords FROM w GROUP BY 1)
    SELECT doc_id, array_to_string(coalesce(keywords, []), ',') AS keywords, CASE WHEN regexp_matches(text, '(?i)\b(api|endpoint|request|response)\b') THEN 'api' ELSE '' END AS tags FROM documents LEFT JOIN k USING (doc_id)""",
)
def p19(spark, d):
    m = extract.text_metadata(table(spark, d, "documents"), "doc_id", "text")
    return m.select("doc_id", F.array_join("keywords", ",").alias("keywords"), F.array_join(F.filter("tags", lambda t: t == "api"), ",").alias("tags"))


@query(
    "p20_importance",
    """WITH m AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'fact' WHEN 1 THEN 'preference' WHEN 2 THEN 'pattern' ELSE 'conversation' END AS t, user_id % 6 AS e, event_id % 3 AS k, value > 10 AS long FROM events)
    SELECT event_id, round(greatest(0, least(1, 0.5 + CASE t WHEN 'fact' THEN 0.2 WHEN 'conversation' THEN 0 ELSE 0.3 END - CASE WHEN long THEN 0 ELSE 0.2 END + 0.1 * least(e, 3) + 0.05 * least(k, 2)))::DOUBLE, 6) AS importance FROM m""",
)
def p20(spark, d):
    k = F.col("event_id") % 4
    kind = F.when(k == 0, "fact").when(k == 1, "preference").when(k == 2, "pattern").otherwise("conversation")
    text = F.when(F.col("value") > 10, "Every build runs twice").otherwise(F.lit("thanks a"))
    return table(spark, d, "events").select("event_id", F.round(extract.importance(kind, text, F.col("user_id") % 6, F.col("event_id") % 3), 6).alias("importance"))


@query(
    "p21_snippet",
    "WITH p AS (SELECT doc_id, text, strpos(lower(text), 'thon') AS a FROM documents) SELECT doc_id, CASE WHEN a > 0 THEN substr(text, greatest(1, a - 100), a + 300 - greatest(1, a - 100)) END AS snippet FROM p",
)
def p21(spark, d):
    return table(spark, d, "documents").select("doc_id", extract.snippet("text", "Thon").alias("snippet"))


@query(
    "p22_extract_fields",
    r"""WITH h AS (SELECT doc_id, substr(text, 1, 5000) AS t FROM documents), f AS (SELECT doc_id, trim(regexp_extract(t, '(thon[a-z]*)', 1), ' ') AS a, trim(regexp_extract(t, '(the) ([a-z]+)', 1) || ' ' || regexp_extract(t, '(the) ([a-z]+)', 2), ' ') AS b, trim(regexp_extract(t, '(eau[a-z]+)', 1), ' ') AS c FROM h)
    SELECT doc_id, CASE WHEN length(a) > 2 THEN a WHEN length(b) > 2 THEN b ELSE '-' END AS subject, CASE WHEN length(c) > 2 THEN c ELSE '-' END AS place FROM f""",
)
def p22(spark, d):
    r = [("subject", r"(thon[a-z]*)"), ("subject", r"(the) ([a-z]+)"), ("place", r"(eau[a-z]+)")]
    return extract.extract_fields(table(spark, d, "documents").select("doc_id", "text"), "text", r, 5000, "-").drop("text")


@query(
    "p23_extract_typed_fields",
    r"""WITH f AS (SELECT doc_id, regexp_extract(text, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS date, regexp_extract(text, '([0-9]+(?:\.[0-9]+)?)', 1) AS amount FROM documents)
    SELECT doc_id, nullif(date, '') AS date, nullif(amount, '') AS amount, ((date <> '')::INTEGER * 90 + (amount <> '')::INTEGER * 85)::BIGINT AS confidence FROM f""",
)
def p23(spark, d):
    r = [("date", r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 90), ("amount", r"([0-9]+(?:\.[0-9]+)?)", 85)]
    x = extract.extract_typed_fields(table(spark, d, "documents"), "text", r)
    at = lambda k: F.try_element_at("fields", F.lit(k))
    return x.select("doc_id", at("date")["value"].alias("date"), at("amount")["value"].alias("amount"), F.aggregate(F.map_values("fields"), F.lit(0).cast("long"), lambda a, v: a + v["confidence"]).alias("confidence"))


CLASS_RULES = [(1, "scope", 5, ["thther"], ["then", "with"], ["eaux"], 0), (2, "payment", 5, ["ntion", "eaux"], ["ing", "les"], [], -2), (3, "term", 8, ["keit"], ["und"], ["thth"], 3), (4, "rest", 1, [], ["e"], [], 0)]


@query(
    "r1_classify_weighted",
    f"""WITH {CLAUSES_SQL}, n AS (SELECT *, max(clause_no) OVER (PARTITION BY doc_id) AS k FROM cl), c AS (SELECT *, (clause_no - 1) / k < 0.25 AS early FROM n),
    s AS (SELECT doc_id, clause_no, CASE WHEN contains(content, 'eaux') THEN 0 ELSE 3 * contains(content, 'thther')::INT + contains(content, 'then')::INT + contains(content, 'with')::INT END AS a,
      3 * (contains(content, 'ntion')::INT + contains(content, 'eaux')::INT) + contains(content, 'ing')::INT + contains(content, 'les')::INT - CASE WHEN early THEN 2 ELSE 0 END AS b,
      CASE WHEN contains(content, 'thth') THEN 0 ELSE 3 * contains(content, 'keit')::INT + contains(content, 'und')::INT + CASE WHEN early THEN 3 ELSE 0 END END AS t, contains(content, 'e')::INT AS r FROM c)
    SELECT doc_id, clause_no, CASE WHEN t > 0 THEN 'term' WHEN a > 0 AND a >= b THEN 'scope' WHEN b > 0 THEN 'payment' WHEN r > 0 THEN 'rest' ELSE 'other' END AS category,
      CASE WHEN t > 0 THEN t WHEN a > 0 AND a >= b THEN a WHEN b > 0 THEN b WHEN r > 0 THEN r ELSE 0 END::INTEGER AS score FROM s""",
)
def r1(spark, d):
    cr = spark.createDataFrame(CLASS_RULES, "seq int, name string, priority int, core array<string>, keywords array<string>, exclude array<string>, early_bonus int")
    return rules.classify_weighted(clauses(spark, d), cr).select("doc_id", "clause_no", "category", "score")


@query("r2_classify_first", f"WITH {CLAUSES_SQL} SELECT doc_id, clause_no, {CAT_SQL} AS category FROM cl")
def r2(spark, d):
    return rules.classify_first(clauses(spark, d), categories(spark)).select("doc_id", "clause_no", "category")


@query("r3_risk_tier", f"WITH {CLAUSES_SQL} SELECT doc_id, clause_no, {TIER_SQL} AS risk_level FROM cl")
def r3(spark, d):
    return rules.risk_tier(clauses(spark, d), tiers(spark)).select("doc_id", "clause_no", "risk_level")


CHECKS = [("c1", "th(on|er)th", "keit", "high"), ("c2", "eau[a-z]+", None, "medium"), ("c3", "[0-9]{3}", "zz9", "low"), ("c4", "[A-Z][a-z]+ción", None, "high")]
ISSUES_SQL = """ck(check_id, pattern, negative, severity) AS (VALUES ('c1', 'th(on|er)th', 'keit', 'high'), ('c2', 'eau[a-z]+', NULL, 'medium'), ('c3', '[0-9]{3}', 'zz9', 'low'), ('c4', '[A-Z][a-z]+ción', NULL, 'high')),
iss AS (SELECT doc_id, check_id, severity, substr(regexp_extract(text, pattern), 1, 50) AS matched FROM documents, ck WHERE regexp_matches(text, pattern) AND NOT coalesce(regexp_matches(text, negative), FALSE))"""


def issues(spark, d):
    return rules.review(table(spark, d, "documents"), spark.createDataFrame(CHECKS, "check_id string, pattern string, negative_pattern string, severity string"))


@query("r4_review", f"WITH {ISSUES_SQL} SELECT * FROM iss")
def r4(spark, d):
    return issues(spark, d)


@query("r5_missing_required", "SELECT doc_id, name, severity FROM documents, (VALUES ('the', 'the', 'low'), ('sum', 'ou[a-z]+re', 'medium')) r(name, pattern, severity) WHERE NOT regexp_matches(coalesce(text, ''), pattern)")
def r5(spark, d):
    return rules.missing_required(table(spark, d, "documents"), spark.createDataFrame([("the", "the", "low"), ("sum", "ou[a-z]+re", "medium")], "name string, pattern string, severity string"))


def points(spark):
    return spark.createDataFrame([("high", 10), ("medium", 5), ("low", 2)], "severity string, points int")


@query(
    "r6_review_verdict",
    f"""WITH {ISSUES_SQL}, g AS (SELECT doc_id, sum(CASE severity WHEN 'high' THEN 10 WHEN 'medium' THEN 5 ELSE 2 END)::BIGINT AS points, count(*) FILTER (severity = 'high') AS n_high, count(*) FILTER (severity = 'medium') AS n_medium, count(*) FILTER (severity = 'low') AS n_low FROM iss GROUP BY 1)
    SELECT *, CASE WHEN points >= 20 THEN 'REJECT' WHEN points >= 10 THEN 'ATTENTION' ELSE 'PASS' END AS verdict FROM g""",
)
def r6(spark, d):
    return rules.review_verdict(issues(spark, d), points(spark))


@query(
    "r7_compliance_score",
    f"""WITH {CLAUSES_SQL}, p AS (SELECT doc_id, clause_no, 100 - 10 * contains(lower(content), 'ntion')::INT - 30 * contains(lower(content), 'eau')::INT - 35 * regexp_matches(lower(content), 'th[aeiou]n')::INT AS b FROM cl)
    SELECT doc_id, clause_no, greatest(0, b)::BIGINT AS score, CASE WHEN b <= 40 THEN 'high' WHEN b <= 70 THEN 'medium' ELSE 'low' END AS level FROM p""",
)
def r7(spark, d):
    p = spark.createDataFrame([("ntion", 10), ("eau", 30), ("th[aeiou]n", 35)], "pattern string, penalty int")
    return rules.compliance_score(clauses(spark, d), p).select("doc_id", "clause_no", "score", "level")


@query(
    "r8_missing_elements",
    f"""WITH {CLAUSES_SQL}, c AS (SELECT *, {CAT_SQL} AS category FROM cl), m AS (SELECT doc_id, 'high' AS level FROM c WHERE category = 'scope' AND NOT (contains(content, 'heed') OR contains(content, 'anst')) UNION ALL SELECT doc_id, 'medium' FROM c WHERE category = 'payment' AND NOT contains(content, 'oui'))
    SELECT doc_id, CASE WHEN count(*) FILTER (level = 'high') > 0 THEN 'red' WHEN count(*) FILTER (level = 'medium') > 0 THEN 'yellow' ELSE 'green' END AS light FROM m GROUP BY 1""",
)
def r8(spark, d):
    e = spark.createDataFrame([("scope", "party", ["heed", "anst"], "high"), ("payment", "date", ["oui"], "medium")], "category string, element string, words array<string>, level string")
    return rules.traffic_light(rules.missing_elements(rules.classify_first(clauses(spark, d), categories(spark)), e))


@query(
    "r9_weighted_risk",
    f"""WITH {ISSUES_SQL} SELECT doc_id, count(*) AS n, least(100, floor(sum(CASE severity WHEN 'high' THEN 100 WHEN 'medium' THEN 50 ELSE 20 END) / count(*)))::BIGINT AS risk_score, count(*) FILTER (check_id IN ('c1', 'c3')) AS n_articles FROM iss GROUP BY 1""",
)
def r9(spark, d):
    i = issues(spark, d).select("doc_id", F.col("check_id").alias("type"), F.col("severity").alias("level"))
    return rules.weighted_risk(i, spark.createDataFrame([("c1", "A-1"), ("c3", "A-3")], "type string, article string"))


OBL_SQL = "s AS (SELECT doc_id, clause_no, content, 3 * contains(content, 'thther')::INT + contains(content, 'ing')::INT + contains(content, 'with')::INT AS a, 3 * contains(content, 'eaux')::INT + contains(content, 'les')::INT AS b FROM cl), ob AS (SELECT doc_id, clause_no, content, CASE WHEN a >= 2 THEN 'D' WHEN b >= 2 THEN 'P' END AS type_code, CASE WHEN a >= 2 THEN a ELSE b END::INTEGER AS score FROM s WHERE a >= 2 OR b >= 2)"


def obligations(spark, d):
    t = spark.createDataFrame([(1, "D", ["thther"], ["ing", "with"]), (2, "P", ["eaux"], ["les"])], "rule_order int, code string, core array<string>, keywords array<string>")
    return rules.extract_obligations(clauses(spark, d), t)


@query("r10_extract_obligations", f"WITH {CLAUSES_SQL}, {OBL_SQL} SELECT doc_id, clause_no, type_code, score FROM ob")
def r10(spark, d):
    return obligations(spark, d).select("doc_id", "clause_no", "type_code", "score")


@query(
    "r11_obligation_confidence",
    f"""WITH {CLAUSES_SQL}, j AS (SELECT doc_id, clause_no, 'D' AS code, contains(content, 'thther')::INT + contains(content, 'heed')::INT AS h, contains(content, 'ing')::INT + contains(content, 'with')::INT + contains(content, 'and')::INT AS m, regexp_matches(content, 'th[ae]n')::INT AS p, contains(content, 'thth')::INT AS bo, contains(content, 'eaux')::INT AS bl, 3 AS pr, 86 AS po FROM cl
      UNION ALL SELECT doc_id, clause_no, 'P', contains(content, 'eaux')::INT, contains(content, 'les')::INT, 0, contains(content, 'oui')::INT, 0, 1, 67 FROM cl WHERE contains(content, 'eau') OR contains(content, 'oui')),
    s AS (SELECT *, 5 * h + 2 * m + 10 * p + 15 * bo - 10 * bl + 3 * pr AS sc FROM j), c0 AS (SELECT *, least(sc / po * 100, 100.0) AS c FROM s WHERE sc > 0), c1 AS (SELECT *, CASE WHEN h >= 1 THEN least(c + 15, 100) ELSE c END AS d1 FROM c0),
    c2 AS (SELECT *, CASE WHEN h >= 2 THEN least(d1 + 10, 100) ELSE d1 END AS d2 FROM c1), c3 AS (SELECT *, CASE WHEN m >= 3 THEN least(d2 + 10, 100) ELSE d2 END AS d3 FROM c2), c4 AS (SELECT *, CASE WHEN p > 0 THEN least(d3 + 20, 100) ELSE d3 END AS d4 FROM c3)
    SELECT doc_id, clause_no, code, round(d4, 6)::DOUBLE AS confidence, (row_number() OVER (PARTITION BY doc_id, clause_no ORDER BY d4 DESC, code))::INTEGER AS rank FROM c4""",
)
def r11(spark, d):
    t = spark.createDataFrame(
        [("D", [], ["thther", "heed"], ["ing", "with", "and"], ["thth"], ["eaux"], ["th[ae]n"], 3), ("P", ["eau", "oui"], ["eaux"], ["les"], ["oui"], [], [], 1)],
        "code string, must_have array<string>, high array<string>, medium array<string>, boost array<string>, block array<string>, patterns array<string>, priority int",
    )
    return rules.obligation_confidence(clauses(spark, d), t).withColumn("confidence", F.round("confidence", 6))


@query(
    "r12_obligation_risk",
    f"""WITH {CLAUSES_SQL}, {OBL_SQL}, p AS (SELECT doc_id, clause_no, CASE type_code WHEN 'D' THEN 3 ELSE 2 END + (clause_no % 3 = 0)::INT + CASE WHEN type_code = 'P' THEN CASE WHEN clause_no % 100 > 50 THEN 2 WHEN clause_no % 100 > 30 THEN 1 ELSE 0 END ELSE 0 END
      + (type_code = 'P' AND NOT contains(content, 'oui'))::INT + (score * 20 < 50)::INT AS k FROM ob) SELECT doc_id, clause_no, k::INTEGER AS risk_points, CASE WHEN k >= 5 THEN 'critical' WHEN k >= 4 THEN 'high' WHEN k >= 2 THEN 'medium' ELSE 'low' END AS risk_level FROM p""",
)
def r12(spark, d):
    o = obligations(spark, d).select("doc_id", "clause_no", F.col("type_code").alias("code"), "content", F.when(F.col("clause_no") % 3 != 0, "soon").alias("deadline"), (F.col("clause_no") % 100).alias("ratio"), (F.col("score") * 20).alias("confidence"))
    return rules.obligation_risk(o, spark.createDataFrame([("D", 3)], "code string, base int"), "P", {"P": "oui"}).select("doc_id", "clause_no", "risk_points", "risk_level")


@query(
    "r13_split_by_category",
    f"""WITH {CLAUSES_SQL}, c AS (SELECT *, {CAT_SQL} AS category FROM cl) SELECT doc_id, 'clause' AS source, clause_no::BIGINT AS ref, CASE category WHEN 'scope' THEN 'delivery' ELSE 'payment' END AS type FROM c WHERE (category = 'scope' AND (length(content) > 200 OR contains(content, 'heed'))) OR (category = 'payment' AND (length(content) > 200 OR contains(content, 'oui')))
    UNION ALL SELECT doc_id, 'item', clause_no, 'delivery' FROM cl WHERE regexp_matches(content, '^The ([a-z]+)')""",
)
def r13(spark, d):
    t = spark.createDataFrame([("scope", "delivery", ["heed"]), ("payment", "payment", ["oui"])], "category string, type string, keywords array<string>")
    items = clauses(spark, d).where(F.col("content").rlike(r"^The ([a-z]+)")).select("doc_id", F.col("clause_no").alias("item_no"))
    return rules.split_by_category(rules.classify_first(clauses(spark, d), categories(spark)), items, t)


def _orders_text(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey"))
    text = F.concat(F.lit("Supply of "), "p_name", F.lit(" made by "), "p_brand", F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit(" ref PC-"), F.lpad(F.col("l_partkey").cast("string"), 6, "0"))).otherwise(F.lit("")))
    return lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_set(text)), "\n").alias("text"))


def _code(key):
    return F.concat(F.lit("PC-"), F.lpad(F.col(key).cast("string"), 6, "0"))


def _products(spark, d):
    return table(spark, d, "part").select("p_partkey", _code("p_partkey").alias("product_code"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("product_model"), F.repeat("p_type", 10).alias("service_description"), F.col("p_retailprice").alias("unit_price"))


_DOC_SQL = """li AS (SELECT l_orderkey AS doc_id, 'Supply of ' || p_name || ' made by ' || p_brand || CASE WHEN l_partkey % 3 = 0 THEN ' ref PC-' || lpad(l_partkey::VARCHAR, 6, '0') ELSE '' END AS t FROM lineitem JOIN part ON l_partkey = p_partkey),
dx AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY t) AS text FROM (SELECT DISTINCT doc_id, t FROM li) GROUP BY 1), px AS (SELECT 'PC-' || lpad(p_partkey::VARCHAR, 6, '0') AS code, lower(p_name) AS nm, lower(p_brand) AS md, least(length(repeat(p_type, 10)) / 500, 0.2) AS ex FROM part)"""


@query(
    "r14_match_products",
    f"""WITH {_DOC_SQL}, tk AS (SELECT doc_id, text, list_distinct(regexp_split_to_array(lower(text), '\\s+')) AS w FROM dx),
    sc AS (SELECT doc_id, code, contains(upper(text), code) AS has, len(list_intersect(list_distinct(string_split(nm, ' ')), w)) / len(list_distinct(string_split(nm, ' '))) * 0.5 + len(list_intersect(list_distinct(string_split(md, ' ')), w)) / len(list_distinct(string_split(md, ' '))) * 0.3 + ex AS s FROM tk, px),
    b AS (SELECT doc_id, code AS product_code, CASE WHEN has THEN greatest(1.0, s) ELSE s END AS score FROM sc WHERE has OR s >= 0.6 - 1e-12), r AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, product_code))::INTEGER AS rank FROM b)
    SELECT doc_id, product_code, round(score, 6)::DOUBLE AS score, rank FROM r WHERE rank <= 5""",
)
def r14(spark, d):
    return rules.match_products(_orders_text(spark, d), _products(spark, d), r"PC-[0-9]{6}").withColumn("score", F.round("score", 6))


@query(
    "r15_deviations",
    """WITH t AS (SELECT p_partkey, p_retailprice AS up, p_type AS ty, CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 1.1 END AS f FROM part),
    g AS (SELECT p_partkey, (f = 0.5)::INTEGER AS n_price, CASE WHEN p_partkey % 5 = 0 THEN 'warranty' END AS scope_word, p_partkey % 7 = 0 AS custom FROM t), s AS (SELECT *, (n_price * 5 + CASE WHEN scope_word IS NULL THEN 0 ELSE 3 END + CASE WHEN custom THEN 6 ELSE 0 END)::INTEGER AS risk_score FROM g)
    SELECT 'PC-' || lpad(p_partkey::VARCHAR, 6, '0') AS product_code, n_price, scope_word, custom, risk_score, CASE WHEN risk_score >= 10 THEN 'high' WHEN risk_score >= 5 THEN 'medium' ELSE 'low' END AS risk_level FROM s""",
)
def r15(spark, d):
    p = _products(spark, d).withColumn("product_code", F.col("p_partkey"))  # codes of over six digits are cut, and so not unique
    n = F.col("product_code")
    text = F.concat(F.lit("Price "), F.format_number(F.col("unit_price") * F.when(n % 2 == 0, 0.5).otherwise(1.1), 2), F.lit(" EUR"), F.when(n % 5 == 0, " with warranty").otherwise(F.lit("")), F.when(n % 7 == 0, ", made to measure").otherwise(F.lit("")))
    terms = p.select("product_code", text.alias("content"))
    return rules.deviations(terms, p, {"price": 5, "scope": 3, "custom": 6}, r"([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)\s*(?:EUR)", ["support", "warranty"], "made to measure|tailored").drop("content").withColumn("product_code", _code("product_code"))


@query(
    "r16_compare_obligations",
    """WITH s(type, std) AS (VALUES ('1-URGENT', 'Customer#000000100'), ('2-HIGH', 'Customer#000000001'), ('9-NONE', 'x')), o AS (SELECT o_custkey AS doc_id, o_orderpriority AS type, min('Customer#' || lpad((o_custkey % 200)::VARCHAR, 9, '0')) AS content FROM orders GROUP BY 1, 2), w AS (SELECT doc_id, s.* FROM (SELECT DISTINCT doc_id FROM o), s),
    j AS (SELECT coalesce(o.doc_id, w.doc_id) AS doc_id, coalesce(o.type, w.type) AS type, content, std, 1 - levenshtein(content, std) / greatest(length(content), length(std)) AS sim FROM o FULL JOIN w ON o.doc_id = w.doc_id AND o.type = w.type)
    SELECT doc_id, type, CASE WHEN std IS NULL THEN 'added' WHEN content IS NULL THEN 'removed' WHEN sim >= 0.95 THEN 'same' WHEN sim >= 0.6 THEN 'changed' ELSE 'replaced' END AS change, round(sim, 6)::DOUBLE AS similarity FROM j""",
)
def r16(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("type")).agg(F.min(F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") % 200).cast("string"), 9, "0"))).alias("content"))
    s = spark.createDataFrame([("1-URGENT", "Customer#000000100"), ("2-HIGH", "Customer#000000001"), ("9-NONE", "x")], "type string, content string")
    return rules.compare_obligations(o, s).withColumn("similarity", F.round("similarity", 6))


@query(
    "r17_items_in_clauses",
    f"""WITH {CLAUSES_SQL}, i AS (SELECT doc_id, unnest(['thon', 'eau', lang]) AS name FROM documents) SELECT doc_id, name, EXISTS (SELECT 1 FROM cl WHERE cl.doc_id = i.doc_id AND contains(content, name)) AS present FROM i""",
)
def r17(spark, d):
    items = table(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit("thon"), F.lit("eau"), "lang")).alias("name"))
    return rules.items_in_clauses(items, clauses(spark, d))


@query("r18_match_error_patterns", "SELECT event_id, pattern FROM events, (VALUES ('ERR'), ('\"k\": 7'), ('click')) p(pattern) WHERE contains(lower(event_type), lower(pattern)) OR contains(lower(props), lower(pattern))")
def r18(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("error"), F.col("props").alias("command"))
    return rules.match_error_patterns(e, spark.createDataFrame([("ERR",), ('"k": 7',), ("click",)], "pattern string")).select("event_id", "pattern")


@query("a12_counts_by", f"WITH {CLAUSES_SQL} SELECT {CAT_SQL} AS category, {TIER_SQL} AS risk_level, count(*) AS n FROM cl GROUP BY 1, 2")
def a12(spark, d):
    c = rules.risk_tier(rules.classify_first(clauses(spark, d), categories(spark)), tiers(spark))
    return stats.counts_by(c, "category", "risk_level")


@query(
    "a13_split_quality",
    f"""WITH {CLAUSES_SQL}, g AS (SELECT doc_id, count(*) AS n_clauses, count(DISTINCT {CAT_SQL}) AS n_categories, avg(length) AS m, count(*) FILTER ({TIER_SQL} <> 'none') AS n_risky FROM cl GROUP BY 1)
    SELECT doc_id, n_clauses, n_categories, round(m, 6) AS mean_length, n_risky, n_clauses BETWEEN 10 AND 25 AND n_categories >= 3 AND m > 50 AND n_risky >= 1 AS passed FROM g""",
)
def a13(spark, d):
    c = rules.risk_tier(rules.classify_first(clauses(spark, d), categories(spark)), tiers(spark))
    return stats.split_quality(c).withColumn("mean_length", F.round("mean_length", 6))


@query(
    "flow_review_verdicts",
    f"""WITH {CLAUSES_SQL}, c AS (SELECT *, {CAT_SQL} AS category, {TIER_SQL} AS risk_level FROM cl), g AS (SELECT doc_id, count(*) AS n_clauses, count(DISTINCT category) AS n_categories, sum(CASE risk_level WHEN 'high' THEN 10 WHEN 'medium' THEN 5 WHEN 'low' THEN 2 ELSE 0 END)::BIGINT AS points FROM c GROUP BY 1)
    SELECT *, CASE WHEN points >= 20 THEN 'REJECT' WHEN points >= 10 THEN 'ATTENTION' ELSE 'PASS' END AS verdict FROM g""",
)
def flow_review_verdicts(spark, d):
    """Documents to verdicts: split, classify, tier, roll up; one shuffle, by document."""
    c = rules.risk_tier(rules.classify_first(clauses(spark, d), categories(spark)), tiers(spark))
    pts = F.when(F.col("risk_level") == "high", 10).when(F.col("risk_level") == "medium", 5).when(F.col("risk_level") == "low", 2).otherwise(0)
    g = c.groupBy("doc_id").agg(F.count("*").alias("n_clauses"), F.count_distinct("category").alias("n_categories"), F.sum(pts).alias("points"))
    return g.withColumn("verdict", F.when(F.col("points") >= 20, "REJECT").when(F.col("points") >= 10, "ATTENTION").otherwise("PASS"))
