"""Rule tables applied to texts: classes, risk tiers, reviews, obligations, products.

Rule tables are small DataFrames. They are gathered into one row of structs that meets every text in a broadcast, so a
match is an expression over an array and needs no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseworks.plans.shared import cut_lineage
from caseworks.operators.search import block_ratio
from caseworks.plans.sizes import few, small


def _with_rules(df: DataFrame, rules: DataFrame, name: str, order: str | None = None) -> DataFrame:
    """df with all rules as one array of structs, in order."""
    packed = rules.agg(F.array_sort(F.collect_list(F.struct(*([order] if order else []), *[c for c in rules.columns if c != order]))).alias(name))
    return df.join(small(packed))  # one row


def _hits(words: Column, text: Column) -> Column:
    return F.filter(words, lambda w: F.contains(text, w))


def _n(words: Column, text: Column) -> Column:
    return F.size(_hits(words, text))


def classify_weighted(clauses: DataFrame, class_rules: DataFrame, strict: bool = True, default: str = "other", early: float = 0.25) -> DataFrame:
    """Adds category and score. Rules: seq, name, priority, core, keywords, exclude (arrays), early_bonus.

    A rule scores 3 for each core word, 1 for each keyword, and its bonus in the first quarter of the document; excluded
    ones don't count. The highest priority wins, then the score, then the earlier rule; strict rules need a score.
    """
    d = _with_rules(clauses, class_rules, "_rules", "seq")
    total = F.max("clause_no").over(Window.partitionBy("doc_id")) if "n_clauses" not in clauses.columns else F.col("n_clauses")
    d = d.withColumn("_early", (F.col("clause_no") - 1) / total < early)
    text = F.col("content")

    def judged(r: Column) -> Column:
        score = 3 * _n(r["core"], text) + _n(r["keywords"], text) + F.when(F.col("_early"), r["early_bonus"]).otherwise(0)
        return F.struct(r["priority"].alias("priority"), score.alias("score"), (-r["seq"]).alias("seq"), r["name"].alias("name"))

    allowed = F.filter("_rules", lambda r: _n(r["exclude"], text) == 0)
    scored = F.transform(allowed, judged)
    best = F.array_max(F.filter(scored, lambda s: s["score"] > 0) if strict else scored)
    return d.withColumns({"category": F.coalesce(best["name"], F.lit(default)), "score": F.coalesce(best["score"], F.lit(0))}).drop("_rules", "_early")


def classify_first(clauses: DataFrame, categories: DataFrame, default: str = "other") -> DataFrame:
    """Adds category: the first of (seq, name, keywords) with a word in the content."""
    d = _with_rules(clauses, categories, "_rules", "seq")
    first = F.get(F.filter("_rules", lambda r: F.exists(r["keywords"], lambda w: F.contains(F.col("content"), w))), 0)
    return d.withColumn("category", F.coalesce(first["name"], F.lit(default))).drop("_rules")


def risk_tier(clauses: DataFrame, risk_tiers: DataFrame, mode: str = "highest") -> DataFrame:
    """Adds risk_level and risk_keywords: the first of (tier, level, keywords) with a hit and its words; mode 'all' lists
    the words of every tier."""
    d = _with_rules(clauses, risk_tiers, "_tiers", "tier")
    text = F.lower("content")
    hit = F.filter("_tiers", lambda t: _n(t["keywords"], text) > 0)
    top = F.get(hit, 0)
    words = F.flatten(F.transform(hit, lambda t: _hits(t["keywords"], text))) if mode == "all" else _hits(top["keywords"], text)
    return d.withColumns({"risk_level": F.coalesce(top["level"], F.lit("none")), "risk_keywords": F.coalesce(words, F.array().cast("array<string>"))}).drop("_tiers")


def review(docs: DataFrame, checks: DataFrame) -> DataFrame:
    """doc_id, check_id, severity, matched (50 characters at most) where a check's pattern matches and its negative
    pattern doesn't. checks: check_id, pattern, negative_pattern (nullable), severity; broadcast if small."""
    j = docs.select("doc_id", "text").join(small(checks), F.rlike(F.col("text"), F.col("pattern")) & ~F.coalesce(F.rlike(F.col("text"), F.col("negative_pattern")), F.lit(False)))
    return j.select("doc_id", "check_id", "severity", F.substring(F.regexp_substr(F.col("text"), F.col("pattern")), 1, 50).alias("matched"))


def missing_required(docs: DataFrame, required: DataFrame) -> DataFrame:
    """doc_id, name, severity of every required clause (name, pattern, severity) that a document lacks."""
    return docs.select("doc_id", "text").join(small(required), ~F.rlike(F.coalesce("text", F.lit("")), F.col("pattern"))).select("doc_id", "name", "severity")


def review_verdict(issues: DataFrame, severity_points: DataFrame, reject: int = 20, attention: int = 10) -> DataFrame:
    """Per document the points of its issues, counts per severity and REJECT, ATTENTION or PASS."""
    j = issues.join(small(severity_points), "severity", "left")
    count = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("high", "medium", "low")]
    g = j.groupBy("doc_id").agg(F.sum(F.coalesce("points", F.lit(0))).alias("points"), *count)
    return g.withColumn("verdict", F.when(F.col("points") >= reject, "REJECT").when(F.col("points") >= attention, "ATTENTION").otherwise("PASS"))


def compliance_score(clauses: DataFrame, penalties: DataFrame, percent_rule: str | None = None) -> DataFrame:
    """Adds score (100 less the penalties of (pattern, penalty) rules that match, 0 at least) and level. Where
    percent_rule matches, the first percentage of 30 or more costs 20, else one of 20 or more costs 10."""
    d = _with_rules(clauses, penalties, "_rules")
    low = F.lower("content")
    lost = F.aggregate("_rules", F.lit(0).cast("long"), lambda a, r: a + F.when(F.rlike(low, r["pattern"]), r["penalty"]).otherwise(0).cast("long"))
    if percent_rule:
        rates = F.transform(F.regexp_extract_all("content", F.lit(r"([0-9]+(?:\.[0-9]+)?)\s*%"), F.lit(1)), lambda x: x.cast("double"))
        first = F.get(F.filter(rates, lambda x: x >= 20), 0)
        lost = lost + F.when(low.rlike(percent_rule) & (first >= 30), 20).when(low.rlike(percent_rule) & (first >= 20), 10).otherwise(0)
    base = 100 - lost
    return d.withColumns({"score": F.greatest(F.lit(0), base).cast("long"), "level": F.when(base <= 40, "high").when(base <= 70, "medium").otherwise("low")}).drop("_rules")


def missing_elements(clauses: DataFrame, element_rules: DataFrame) -> DataFrame:
    """doc_id, clause_no, element, level where a clause of a rule's category has none of its words (category, element,
    words, level)."""
    j = clauses.join(small(element_rules), "category")
    return j.where(~F.exists("words", lambda w: F.contains(F.col("content"), w))).select("doc_id", "clause_no", "element", "level")


def traffic_light(issues: DataFrame) -> DataFrame:
    """Per document red with any high issue, yellow with any medium, else green."""
    return issues.groupBy("doc_id").agg(F.when(F.count_if(F.col("level") == "high") > 0, "red").when(F.count_if(F.col("level") == "medium") > 0, "yellow").otherwise("green").alias("light"))


def weighted_risk(issues: DataFrame, law_refs: DataFrame) -> DataFrame:
    """Per document min(100, int((100 high + 50 medium + 20 low) / n)) and the number of issues with a law reference."""
    j = issues.join(small(law_refs.select("type", "article")), "type", "left")
    points = F.when(F.col("level") == "high", 100).when(F.col("level") == "medium", 50).otherwise(20)
    return j.groupBy("doc_id").agg(F.count("*").alias("n"), F.least(F.lit(100), F.floor(F.sum(points) / F.count("*"))).cast("long").alias("risk_score"), F.count("article").alias("n_articles"))


def extract_obligations(clauses: DataFrame, obligation_types: DataFrame, min_score: int = 2) -> DataFrame:
    """Clauses with the first type (rule_order, code, core, keywords) of score 3 per core word + 1 per keyword >= min."""
    d = _with_rules(clauses, obligation_types, "_types", "rule_order")
    text = F.col("content")
    scored = F.transform("_types", lambda t: F.struct(t["code"].alias("code"), (3 * _n(t["core"], text) + _n(t["keywords"], text)).alias("score")))
    first = F.get(F.filter(scored, lambda s: s["score"] >= min_score), 0)
    return d.withColumns({"type_code": first["code"], "score": first["score"]}).where("type_code IS NOT NULL").drop("_types")


def obligation_confidence(clauses: DataFrame, type_rules: DataFrame) -> DataFrame:
    """doc_id, clause_no, code, confidence, rank of every type a clause may have.

    Rules: code, must_have, high, medium, boost, block (arrays), patterns (array), priority. Must-have words gate; 5 a
    high word, 2 a medium one, 10 a pattern, 15 a boost, -10 a block, 3 x priority; the confidence relates that to what
    was possible, and adds for several hits.
    """
    d, t = _with_rules(clauses.select("doc_id", "clause_no", "content"), type_rules, "_types", "code"), F.col("content")

    def judged(r: Column) -> Column:
        high, medium, found = _n(r["high"], t), _n(r["medium"], t), F.size(F.filter(r["patterns"], lambda p: F.rlike(t, p)))
        score = 5 * high + 2 * medium + 10 * found + 15 * _n(r["boost"], t) - 10 * _n(r["block"], t) + 3 * r["priority"]
        possible = 5 * F.size(r["high"]) + 2 * F.size(r["medium"]) + 10 * F.size(r["patterns"]) + 60
        c = F.least(score / possible * 100, F.lit(100.0))
        for cond, add in ((high >= 1, 15), (high >= 2, 10), (medium >= 3, 10), (found > 0, 20)):
            c = F.when(cond, F.least(c + add, F.lit(100.0))).otherwise(c)
        gate = (F.size(r["must_have"]) == 0) | (_n(r["must_have"], t) > 0)
        return F.when(gate & (score > 0), F.struct((-c).alias("down"), r["code"].alias("code")))

    ranked = F.array_sort(F.filter(F.transform("_types", judged), lambda x: x.isNotNull()))  # best first, inside the row
    out = d.select("doc_id", "clause_no", F.posexplode(ranked).alias("_i", "_x"))
    return out.select("doc_id", "clause_no", F.col("_x.code").alias("code"), (-F.col("_x.down")).alias("confidence"), (F.col("_i") + 1).alias("rank"))


def obligation_risk(obligations: DataFrame, base_risk: DataFrame, payment: str, needed: dict[str, str]) -> DataFrame:
    """Adds risk_points and risk_level of (code, content, deadline, ratio, confidence): base 1-4 by code (2 if unknown),
    +1 without a deadline, payments +2/+1 for a ratio over 50/30, +1 where a code's needed word is missing, +1 under 50
    confidence; 5 critical, 4 high, 2 medium."""
    j = obligations.join(small(base_risk.select("code", "base")), "code", "left")
    points = F.coalesce("base", F.lit(2)) + F.when(F.coalesce("deadline", F.lit("")) == "", 1).otherwise(0)
    points = points + F.when((F.col("code") == payment) & (F.col("ratio") > 50), 2).when((F.col("code") == payment) & (F.col("ratio") > 30), 1).otherwise(0)
    for code, word in needed.items():
        points = points + F.when((F.col("code") == code) & ~F.contains(F.col("content"), F.lit(word)), 1).otherwise(0)
    points = points + F.when(F.col("confidence") < 50, 1).otherwise(0)
    j = j.withColumn("risk_points", points)
    level = F.when(F.col("risk_points") >= 5, "critical").when(F.col("risk_points") >= 4, "high").when(F.col("risk_points") >= 2, "medium").otherwise("low")
    return j.withColumn("risk_level", level).drop("base")


def split_by_category(clauses: DataFrame, items: DataFrame, types: DataFrame, long: int = 200) -> DataFrame:
    """doc_id, source, ref, type: clauses whose category has a type (category, type, keywords) and that hold one of its
    words or are long, and one delivery obligation for each line item."""
    j = clauses.join(small(types), "category").where((F.length("content") > long) | F.exists("keywords", lambda w: F.contains(F.col("content"), w)))
    a = j.select("doc_id", F.lit("clause").alias("source"), F.col("clause_no").cast("long").alias("ref"), "type")
    return a.unionByName(items.select("doc_id", F.lit("item").alias("source"), F.col("item_no").cast("long").alias("ref"), F.lit("delivery").alias("type")))


def match_products(docs: DataFrame, products: DataFrame, code_pattern: str, threshold: float = 0.6, k: int = 5) -> DataFrame:
    """doc_id, product_code, score, rank of the k best products of a document.

    A code found in the text scores 1. Otherwise 0.5 x share of the name's words in the text + 0.3 x share of the
    model's + min(description length / 500, 0.2), from the threshold on. Documents that hold the same words of the
    catalogue score alike, so they are one word set; and sets that hold the same words of names (of models) share the names
    (the models) that they meet, which are judged once for all of these, on their rare words only. The k best
    products are worked out for each name and model, from these for each set of name words and model, and from these for
    each set, so that the work on pairs doesn't grow with the documents. The
    threshold comes down in three steps from the best score that there can be; sets that find k products on the way are done.
    """
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))
    p = products.select(F.upper("product_code").alias("product_code"), F.sort_array(tokens(F.col("product_name"))).alias("name"), F.sort_array(tokens(F.col("product_model"))).alias("model"), F.least(F.length("service_description") / 500, F.lit(0.2)).alias("extra"))
    first = p.where("name IS NOT NULL AND model IS NOT NULL AND extra IS NOT NULL").withColumn("_r", F.row_number().over(Window.partitionBy("name", "model", "extra").orderBy("product_code"))).where(F.col("_r") <= k)
    first = cut_lineage(first.select("product_code", "name", "model", "extra", F.xxhash64("name").alias("name_id"), F.xxhash64("model").alias("model_id")))
    any_ = F.lit(None).cast("long")
    of_pairs = []  # of a name and a model, a name and any model, any name and a model: products in order of extra and code
    for name_id, model_id in ((F.col("name_id"), F.col("model_id")), (F.col("name_id"), any_), (any_, F.col("model_id"))):
        each = first.select(F.coalesce(name_id, F.lit(0)).alias("name_id"), F.coalesce(model_id, F.lit(0)).alias("model_id"), "extra", "product_code")
        w = Window.partitionBy("name_id", "model_id").orderBy(F.desc("extra"), "product_code")
        best = F.array_sort(F.collect_list(F.struct("_r", "extra", "product_code")))
        of_pairs.append(each.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy("name_id", "model_id").agg(best.alias("best")))
    known = cut_lineage(reduce(DataFrame.unionByName, of_pairs))
    best_extra = first.agg(F.max("extra")).first()[0] or 0.0
    kinds = {"name": 0.5, "model": 0.3}
    parts = {kind: cut_lineage(first.select(f"{kind}_id", kind).distinct()) for kind in kinds}
    words = {kind: parts[kind].select(f"{kind}_id", kind, F.explode(kind).alias("token")) for kind in kinds}
    vocabulary = reduce(lambda a, b: a.join(b, "token", "full"), [words[kind].select("token", F.lit(True).alias(f"in_{kind}")).distinct() for kind in kinds])
    vocabulary = few(cut_lineage(vocabulary))
    held = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("token")).join(vocabulary.select("token"), "token").groupBy("doc_id").agg(F.sort_array(F.collect_list("token")).alias("own"))
    held = cut_lineage(held.withColumn("set", F.xxhash64("own")))
    each = held.groupBy("set").agg(F.first("own").alias("own")).select("set", F.explode(F.array_distinct("own")).alias("token")).join(vocabulary, "token").groupBy("set")
    each = each.agg(*[F.sort_array(F.collect_list(F.when(F.col(f"in_{kind}"), F.col("token")))).alias(f"{kind}s") for kind in kinds])
    sets = cut_lineage(each.select("*", *[F.xxhash64(f"{kind}s").alias(f"{kind}_set") for kind in kinds]))
    own, index = {}, {}
    for kind, weight in kinds.items():
        own[kind] = cut_lineage(sets.groupBy(f"{kind}_set").agg(F.first(f"{kind}s").alias("own")))
        common = own[kind].select(F.explode("own").alias("token")).groupBy("token").agg(F.count("*").alias("f"))
        upto = F.count("*").over(Window.partitionBy(f"{kind}_id").orderBy(F.desc("f"), "token")) / F.size(kind) * weight
        index[kind] = cut_lineage(words[kind].join(common, "token").select("token", f"{kind}_id", kind, upto.alias("most")))

    def hits(kind: str, least: float) -> DataFrame:
        """({kind}_set, hits): the names (models) of each set of words that can reach the threshold with the best other
        part, with the part of the score that they give; also 0, any name (model), which gives nothing."""
        need = least - best_extra - sum(w for other, w in kinds.items() if other != kind) - 1e-9
        met = own[kind].select(f"{kind}_set", "own", F.explode("own").alias("token")).join(few(index[kind].where(F.col("most") >= need)), "token")
        found = met.select(f"{kind}_set", f"{kind}_id", (F.size(F.array_intersect(kind, "own")) / F.size(kind) * kinds[kind]).alias("part")).where(F.col("part") >= need).distinct()
        nothing = own[kind].select(f"{kind}_set", F.lit(0).cast("long").alias(f"{kind}_id"), F.lit(0.0).alias("part"))
        both = found.unionByName(nothing) if need <= 0 else found
        return both.groupBy(f"{kind}_set").agg(F.collect_list(F.struct(f"{kind}_id", "part")).alias(f"{kind}_hits"))

    def best_of(some: DataFrame, least: float) -> DataFrame:
        """(set, product_code, score): the k best products of each set, from the threshold on. The k best of each set of name
        words and each model come first; they are among those of the 2 k best pairs of name and model, as a product is in two
        of these at most (with its name, and with any)."""
        order = lambda score, code: [F.desc(F.round(score, 9)), code]
        models = some.select("set", "name_set", "model_set").join(hits("model", least), "model_set").select("set", "name_set", F.explode("model_hits").alias("m"))
        models = cut_lineage(models.select("set", "name_set", "m.model_id", F.col("m.part").alias("model_part")))
        names = models.select("name_set", "model_id").distinct().join(hits("name", least), "name_set").select("name_set", "model_id", F.explode("name_hits").alias("n"))
        names = names.select("name_set", "model_id", F.col("n.name_id").alias("name_id"), F.col("n.part").alias("part")).join(few(known), ["name_id", "model_id"])
        of = Window.partitionBy("name_set", "model_id")
        first = F.col("best")[0]
        names = names.withColumn("_r", F.row_number().over(of.orderBy(*order(F.col("part") + first["extra"], first["product_code"])))).where(F.col("_r") <= 2 * k)
        names = names.select("name_set", "model_id", "part", F.explode("best").alias("b")).select("name_set", "model_id", "b.product_code", (F.col("part") + F.col("b.extra")).alias("score"), "part", "b.extra")
        names = names.where(F.col("score") + kinds["model"] >= least - 1e-9).groupBy("name_set", "model_id", "product_code").agg(F.max(F.struct("score", "part", "extra")).alias("b"))
        names = names.withColumn("_r", F.row_number().over(of.orderBy(*order(F.col("b.score"), F.col("product_code"))))).where(F.col("_r") <= k)
        score = F.col("b.part") + F.col("model_part") + F.col("b.extra")
        each = models.join(names, ["name_set", "model_id"]).select("set", "product_code", score.alias("score")).where(F.col("score") >= least - 1e-12)
        each = each.groupBy("set", "product_code").agg(F.max("score").alias("score"))  # a product of any model scores more by its own
        return each.withColumn("_r", F.row_number().over(Window.partitionBy("set").orderBy(*order(F.col("score"), F.col("product_code"))))).where(F.col("_r") <= k).drop("_r")

    whole = lambda kind: F.when(F.size(kind) > 0, kinds[kind]).otherwise(0.0)
    top = first.agg(F.max(whole("name") + whole("model") + F.col("extra"))).first()[0] or threshold
    found, some = [], sets
    for least in sorted({max(threshold, x) for x in (top - 1e-9, (top + threshold) / 2, threshold)}, reverse=True):
        best = cut_lineage(best_of(some, least))
        done = best.groupBy("set").agg(F.count("*").alias("n")).where((F.col("n") >= k) | F.lit(least == threshold)).select("set")
        found.append(best.join(done, "set", "left_semi"))
        some = some.join(done, "set", "left_anti")
    by_words = held.select("doc_id", "set").join(reduce(DataFrame.unionByName, found), "set").select("doc_id", "product_code", "score")
    codes = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit(code_pattern), F.lit(0)))).alias("product_code")).join(small(p.select("product_code").distinct()), "product_code")
    best = codes.select("doc_id", "product_code", F.lit(1.0).alias("score")).unionByName(by_words).groupBy("doc_id", "product_code").agg(F.max("score").alias("score"))
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.round("score", 9)), "product_code")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def deviations(terms: DataFrame, products: DataFrame, points: dict[str, int], price: str, scope: list[str], custom: str) -> DataFrame:
    """Adds n_price, scope_word, custom, risk_score and risk_level of terms (product_code, content) against the product's
    price and description: prices off by more than 15 %, the first scope word that the description lacks, custom words."""
    j = terms.join(small(products.select("product_code", "unit_price", "service_description")), "product_code")
    found = F.transform(F.regexp_extract_all("content", F.lit(price), F.lit(1)), lambda x: F.replace(x, F.lit(",")).cast("double"))
    off = F.size(F.filter(found, lambda x: F.abs(x - F.col("unit_price")) / F.col("unit_price") > 0.15))
    word = F.get(F.filter(F.array(*[F.lit(w) for w in scope]), lambda w: F.contains(F.col("content"), w) & ~F.contains(F.col("service_description"), w)), 0)
    j = j.withColumns({"n_price": off, "scope_word": word, "custom": F.col("content").rlike(custom)})
    score = F.col("n_price") * points["price"] + F.when(F.col("scope_word").isNotNull(), points["scope"]).otherwise(0) + F.when(F.col("custom"), points["custom"]).otherwise(0)
    return j.withColumn("risk_score", score).withColumn("risk_level", F.when(F.col("risk_score") >= 10, "high").when(F.col("risk_score") >= 5, "medium").otherwise("low")).drop("unit_price", "service_description")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def compare_obligations(obligations: DataFrame, standard: DataFrame, measure: str = "edit") -> DataFrame:
    """doc_id, type, change, similarity of a document's obligations (doc_id, type, content) against the standard's
    (type, content): same from 0.95, changed from 0.6, else replaced; added and removed where one side lacks the type.
    measure: 'edit' (distance over length) or 'blocks' (ratio of longest matching blocks); both work on characters."""
    docs = obligations.select("doc_id").distinct()
    wanted = docs.join(small(standard.select("type", F.col("content").alias("std"))))
    j = obligations.select("doc_id", "type", "content").join(wanted, ["doc_id", "type"], "full_outer")
    s = similarity(F.col("content"), F.col("std")) if measure == "edit" else F.when(F.col("content").isNotNull() & F.col("std").isNotNull(), block_ratio("content", "std"))
    change = F.when(F.col("std").isNull(), "added").when(F.col("content").isNull(), "removed").when(s >= 0.95, "same").when(s >= 0.6, "changed").otherwise("replaced")
    return j.select("doc_id", "type", change.alias("change"), s.alias("similarity"))


def items_in_clauses(items: DataFrame, clauses: DataFrame) -> DataFrame:
    """Items (doc_id, name) with present: whether the name occurs in any of the document's clauses."""
    hit = items.select("doc_id", "name").distinct().join(clauses.select("doc_id", "content"), "doc_id").where(F.contains(F.col("content"), F.col("name"))).select("doc_id", "name").distinct().withColumn("present", F.lit(True))
    return items.join(hit, ["doc_id", "name"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def match_error_patterns(errors: DataFrame, patterns: DataFrame) -> DataFrame:
    """Errors (error, command) with each known pattern that either contains, in any case."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return errors.join(small(patterns), F.contains(low("error"), F.lower("pattern")) | F.contains(low("command"), F.lower("pattern")))
