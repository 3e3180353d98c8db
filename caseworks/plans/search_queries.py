"""Queries of search and similarity on documents, embeddings and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseworks.operators import closetext, postings, search, vectors
from caseworks.plans.registry import query, table
from caseworks.plans.shared import cut_lineage

_VQ = "SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0"


@query(
    "x1_vector_topk",
    f"""WITH q AS ({_VQ}), s AS (SELECT query_id, vec_id AS id, label AS collection, list_cosine_similarity(q, embedding::DOUBLE[]) AS score FROM q, embeddings),
    r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id))::INTEGER AS rank FROM s) SELECT query_id, id, collection, round(score, 6) AS score, rank FROM r WHERE rank <= 5""",
)
def x1(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("collection"))
    q = e.where("id % 100 = 0").select(F.col("id").alias("query_id"), "v")
    return search.vector_topk(q, e, 5).withColumn("score", F.round("score", 6))


@query(
    "x1_vector_topk_l2",
    f"""WITH q AS ({_VQ}), s AS (SELECT query_id, vec_id AS id, label AS collection, 1 / (1 + list_distance(q, embedding::DOUBLE[]) ** 2) AS score FROM q, embeddings),
    r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id))::INTEGER AS rank FROM s) SELECT query_id, id, collection, round(score, 6) AS score, rank FROM r WHERE rank <= 5 AND score >= 0.4""",
)
def x1_l2(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("collection"))
    q = e.where("id % 100 = 0").select(F.col("id").alias("query_id"), "v")
    return search.vector_topk(q, e, 5, "l2", 0.4).withColumn("score", F.round("score", 6))


@query("x2_search_like", "SELECT doc_id AS chunk_id, 0.99::DOUBLE AS score FROM documents WHERE text ILIKE '%thon%er_d%' ORDER BY doc_id LIMIT 20")
def x2(spark, d):
    c = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk"))
    return search.search_like(c, "thon%er_d", 20).select("chunk_id", F.col("score").cast("double").alias("score"))


@query(
    "x3_inverted_index",
    r"""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\pL\pN]+')) AS term FROM documents) SELECT term, count(*) AS n, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS ids FROM w WHERE term <> '' GROUP BY 1""",
)
def x3(spark, d):
    i = search.inverted_index(table(spark, d, "documents"), "doc_id", "text")
    return i.select("term", "n", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids"))


_TERMS = r"w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^\pL\pN]+')) AS term FROM documents)"


@query("x3_index_blocks", f"WITH {_TERMS} SELECT term, count(*) AS n, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS ids, TRUE AS bounded FROM w WHERE term <> '' GROUP BY 1")
def x3_blocks(spark, d):
    """The index in blocks of 64, unpacked; and whether no block holds more, or ids outside its first and last one."""
    i = cut_lineage(postings.index_blocks(table(spark, d, "documents"), "doc_id", "text", 64))
    ids = postings.unpack(i).groupBy("term").agg(F.count("*").alias("n"), F.md5(F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",")).alias("ids"), F.min("id").alias("a"), F.max("id").alias("b"))
    b = i.groupBy(F.col("term").alias("t")).agg(F.max("n").alias("most"), F.min("first").alias("f"), F.max("last").alias("l"))
    return ids.join(b, F.col("term") == F.col("t")).select("term", "n", "ids", ((F.col("most") <= 64) & (F.col("a") == F.col("f")) & (F.col("b") == F.col("l"))).alias("bounded"))


@query("x3_lookup_all", f"WITH {_TERMS} SELECT doc_id AS id FROM w WHERE term IN ('the', 'it', 'ble') GROUP BY 1 HAVING count(*) = 3")
def x3_lookup(spark, d):
    i = cut_lineage(postings.index_blocks(table(spark, d, "documents"), "doc_id", "text", 64))
    return postings.lookup_all(i, ["the", "it", "ble"])


@query("x3_category_index", "SELECT source, count(*) AS n, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS ids FROM documents GROUP BY 1")
def x3b(spark, d):
    return search.category_index(table(spark, d, "documents"), "doc_id", "source").select("source", "n", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids"))


@query(
    "x4_rank_keywords",
    """WITH p AS (SELECT p_partkey AS id, lower(p_name || ' ' || p_type || ' ' || p_brand) AS w, lower(p_name) AS t FROM part), s AS (SELECT id, CASE WHEN contains(w, 'red') THEN 100 + CASE WHEN contains(t, 'red') THEN 15 ELSE 0 END WHEN contains(w, 're') THEN 50 ELSE 0 END
      + CASE WHEN contains(w, 'widgets') THEN 100 + CASE WHEN contains(t, 'widgets') THEN 15 ELSE 0 END WHEN contains(w, 'wi') THEN 50 / 3 ELSE 0 END + CASE WHEN contains(w, 'economy') THEN 100 + CASE WHEN contains(t, 'economy') THEN 15 ELSE 0 END WHEN contains(w, 'ec') THEN 50 / 3 ELSE 0 END AS score FROM p)
    SELECT id, round(score, 6)::DOUBLE AS score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 30""",
)
def x4(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_partkey", "id")
    return search.rank_keywords(p, ["Red", "widgets", "ECONOMY"], ["p_name", "p_type", "p_brand"], "p_name", 30).select("id", F.round("score", 6).alias("score"))


@query("x5_search_any", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring') ORDER BY 1 LIMIT 50")
def x5(spark, d):
    return search.search_any(table(spark, d, "part"), "RING", ["p_name", "p_brand", "p_type"], 50, "p_partkey").select("p_partkey")


@query(
    "x6_rank_similar",
    """WITH s AS (SELECT p_partkey AS id, 0.3 * ((p_type = 'ECONOMY')::INT + (p_brand = 'Brand#7')::INT) + CASE WHEN contains(lower(p_name), 'red ring') THEN 0.5 ELSE 0 END
      + len(list_intersect(list_distinct(string_split(lower(p_name), ' ')), ['red', 'ring'])) / (len(list_distinct(string_split(lower(p_name), ' '))) + 2 - len(list_intersect(list_distinct(string_split(lower(p_name), ' ')), ['red', 'ring']))) AS score FROM part)
    SELECT id, round(score, 6)::DOUBLE AS score FROM s WHERE score > 0.1 ORDER BY score DESC, id LIMIT 25""",
)
def x6(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_name").alias("content"), F.array("p_type", "p_brand").alias("tags"))
    return search.rank_similar(p, "red ring", ["ECONOMY", "Brand#7"], 25).select("id", F.round("score", 6).alias("score"))


def _like(words, text):
    own = f"[x for x in list_distinct(regexp_split_to_array(lower({text}), '[^\\pL\\pN]+')) if x <> '']"
    both = f"len(list_intersect({own}, {words}))"
    return f"({both} / (len({own}) + {len(words)} - {both}))"


_SKILL = f"0.3 * (contains(lower(p_brand), 'red')::INT + (contains(lower(p_type), 'red') OR contains(lower(p_type), 'eco'))::INT) + 0.5 * {_like(['red', 'eco', 'a', 'ring'], "p_name || ' ' || p_type")}"


def _skills(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.array("p_brand", "p_type").alias("tags"), F.element_at(F.array(*[F.lit(x) for x in ("production", "beta", "prototype", "deprecated", "other")]), (F.col("p_size") % 5 + 1).cast("int")).alias("maturity"), (F.col("p_size") / 50).alias("success_rate"), F.when(F.col("p_size") % 4 > 0, 0.8).alias("confidence"))


@query(
    "x6_rank_skills",
    f"""SELECT id, round(score, 6)::DOUBLE AS score FROM (SELECT p_partkey AS id, ({_SKILL}) * [1.0, 0.7, 0.4, 0.1, 0.3][p_size % 5 + 1] + 0.2 * p_size / 50 AS score FROM part) WHERE score > 0.1 ORDER BY score DESC, id LIMIT 25""",
)
def x6_skills(spark, d):
    return search.rank_skills(_skills(spark, d), "red eco a ring", 25).select("id", F.round("score", 6).alias("score"))


@query(
    "x6_rank_entities",
    f"""WITH g AS (SELECT p, count(*) AS n FROM (SELECT l_partkey AS p FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem WHERE l_suppkey <> l_partkey) GROUP BY 1)
    SELECT id, round(score, 6)::DOUBLE AS score FROM (SELECT p_partkey AS id, (({_SKILL}) + least(coalesce(n, 0) * 0.05, 0.3)) * CASE WHEN p_size % 4 > 0 THEN 0.8 ELSE 1 END AS score FROM part LEFT JOIN g ON p = p_partkey) WHERE score > 0 ORDER BY score DESC, id LIMIT 25""",
)
def x6_entities(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return search.rank_entities(_skills(spark, d), edges, "red eco a ring", 25).select("id", F.round("score", 6).alias("score"))


@query("x8_near_texts")
def x8_near(spark, d):
    return closetext.near_texts(table(spark, d, "benchmark"), "item_id", "text", 0.5)


@query("x7_dedup_text")
def x7(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return search.dedup_text(lines.where(F.length("line") >= 3), "doc_id", "line", "line_no")


@query(
    "x8_similar_pairs",
    r"""WITH w AS (SELECT doc_id, list_distinct([x for x in regexp_split_to_array(lower(text), '[^\pL\pN]+') if x <> '']) AS w FROM documents), p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.w, b.w)) AS k, len(a.w) AS na, len(b.w) AS nb FROM w a JOIN w b ON a.doc_id < b.doc_id AND least(len(a.w), len(b.w)) >= 0.6 * greatest(len(a.w), len(b.w)))
    SELECT a, b, round(k / (na + nb - k), 6)::DOUBLE AS similarity FROM p WHERE k / (na + nb - k) > 0.6""",
)
def x8(spark, d):
    return search.similar_pairs(table(spark, d, "documents"), "doc_id", "text").withColumn("similarity", F.round("similarity", 6))


@query(
    "x9_tag_pairs",
    """WITH t AS (SELECT DISTINCT l_suppkey AS i, 'p' || l_partkey AS t FROM lineitem) SELECT x.i AS a, y.i AS b, count(*) AS n_shared FROM t x JOIN t y ON x.t = y.t AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def x9(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_set(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("tags"))
    return search.tag_pairs(t, "l_suppkey", "tags").select("a", "b", "n_shared")


@query(
    "x10_near_dup_vectors",
    """SELECT x.label, x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS similarity FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id
    WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) > 0.35""",
)
def x10(spark, d):
    return search.near_dup_vectors(table(spark, d, "embeddings"), "label", "embedding", "vec_id", 0.35).withColumn("similarity", F.round("similarity", 6))


_PLANTED = """WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
    e AS (SELECT id, label, v FROM v UNION ALL SELECT id + k * 10000000, label, list_transform(v, lambda x, i: x + k * 0.012 * sin(i - 1 + id)) FROM v, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE id % 5 = k
      UNION ALL SELECT id + 90000000, label, v FROM v WHERE id % 9 = 0),
    u AS (SELECT label, v, min(id) AS id FROM e GROUP BY 1, 2)"""


def _planted(spark, d):
    """Embeddings, near copies of four fifths of them at four distances, and exact copies of a ninth."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    k = F.col("id") % 5
    near = e.where(k > 0).withColumn("v", F.transform("v", lambda x, i: x + k * 0.012 * F.sin(i + F.col("id")))).withColumn("id", F.col("id") + k * 10000000)
    return e.unionByName(near).unionByName(e.where("id % 9 = 0").select((F.col("id") + 90000000).alias("id"), "label", "v"))


@query(
    "x10_near_dup_hashed",
    f"""{_PLANTED} SELECT x.label, x.id AS a, y.id AS b, round(list_cosine_similarity(x.v, y.v), 6) AS similarity FROM u x JOIN u y ON x.label = y.label AND x.id < y.id WHERE list_cosine_similarity(x.v, y.v) > 0.95""",
)
def x10_hashed(spark, d):
    return vectors.near_dup_hashed(_planted(spark, d), "label", "v", "id", 0.95, 0.9999).withColumn("similarity", F.round("similarity", 6))


@query("x10_vector_classes", f"{_PLANTED} SELECT label AS owner, e.id, u.id AS class FROM e JOIN u USING (label, v)")
def x10_classes(spark, d):
    return vectors.distinct_vectors(_planted(spark, d), "label", "v", "id")[1]
