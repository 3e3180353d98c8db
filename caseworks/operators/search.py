"""Search and similarity: vectors, substrings, indexes, keyword ranks, similar and near-duplicate pairs."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from caseworks.operators import wordsets
from caseworks.plans.shared import written
from caseworks.plans.sizes import small

#: Query vectors that one block product takes; more queries are done in several.
QUERY_BLOCK = 4096
#: Scores of queries and a batch of vectors that a task holds at once.
SCORES = 1 << 21


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _block_topk(vectors: DataFrame, ids: list[int], queries: np.ndarray, k: int, metric: str, group: str) -> DataFrame:
    """Every task's k best (query_id, id, group, score) for a block of queries, by one matrix product a batch."""
    q = queries.astype(np.float64)
    if metric == "cosine":
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

    asked = np.array(ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            if metric == "cosine":
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            own, groups = pdf["id"].to_numpy(), pdf[group].to_numpy()
            strip = max(1, SCORES // len(v))
            for a in range(0, len(q), strip):
                part = q[a : a + strip]
                scores = part @ v.T if metric == "cosine" else 1 / (1 + np.maximum(0, (part * part).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * part @ v.T))
                for g in pd.unique(groups):
                    at = np.flatnonzero(groups == g)
                    order = np.lexsort((np.broadcast_to(own[at], (len(part), len(at))), -np.round(scores[:, at], 12)), axis=1)[:, :k]
                    n = order.shape[1]
                    yield pd.DataFrame({"query_id": np.repeat(asked[a : a + strip], n), "id": own[at][order.reshape(-1)], group: g, "score": np.take_along_axis(scores[:, at], order, 1).reshape(-1)})

    kind = dict(vectors.dtypes)[group]
    return vectors.select("id", "v", group).mapInPandas(run, f"query_id long, id long, `{group}` {kind}, score double")


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", threshold: float | None = None, group: str = "collection") -> DataFrame:
    """query_id, id, group, score, rank: the k best per query over all groups, from each group's k best.

    metric 'cosine', or 'l2' as 1 / (1 + squared distance). Queries (query_id, v) go out in blocks of QUERY_BLOCK; each
    block meets every vector in matrix products, and only k rows a task and group are shuffled. The threshold is applied
    after the top k.
    """
    held = queries.select("query_id", "v").orderBy("query_id")
    total, parts = held.count(), []
    for a in range(0, max(total, 1), QUERY_BLOCK):
        rows = held.offset(a).limit(QUERY_BLOCK).collect()
        if rows:
            parts.append(_block_topk(vectors, [r.query_id for r in rows], np.array([r.v for r in rows], np.float64), k, metric, group))
    if not parts:
        return vectors.select(F.lit(0).cast("long").alias("query_id"), "id", group, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    found = reduce(DataFrame.unionByName, parts)
    order = [F.desc(F.round("score", 12)), F.asc("id")]
    per_group = found.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", group).orderBy(*order))).where(F.col("_r") <= k).drop("_r")
    best = per_group.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return best.where(F.col("score") >= threshold) if threshold is not None else best


def search_like(chunks: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Chunks that contain the query in any case (% and _ are wildcards), by chunk id, with the constant score 0.99."""
    return chunks.where(F.col("chunk").ilike(f"%{query}%")).orderBy("chunk_id").limit(limit).withColumn("score", F.lit(0.99))


def inverted_index(docs: DataFrame, id: str, text: str) -> DataFrame:
    """term, n and doc ids (sorted) of each lower-case word. A term's ids are one row: for stop words use term_postings."""
    terms = term_postings(docs, id, text)
    return terms.groupBy("term").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(id)).alias("ids"))


def term_postings(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(term, id) rows, one for each distinct word of a document: the index in long form, of any size."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    return docs.select(id, F.explode(words).alias("term"))


def category_index(docs: DataFrame, id: str, category: str) -> DataFrame:
    return docs.groupBy(category).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(id)).alias("ids"))


def rank_keywords(docs: DataFrame, keywords: list[str], fields: list[str], title: str, n: int = 10) -> DataFrame:
    """Docs with score and matched keywords, best n first: 100 for each keyword in any field and 15 more in the title;
    else 50 / its parts if its first two letters occur. Ties by id."""
    whole = F.lower(F.concat_ws(" ", *fields))
    parts, names = [], []
    for k in keywords:
        low = k.lower()
        full = F.contains(whole, F.lit(low))
        part = F.contains(whole, F.lit(low[:2]))
        parts.append(F.when(full, 100.0 + F.when(F.contains(F.lower(title), F.lit(low)), 15.0).otherwise(0.0)).when(part, 50.0 / max(1, len(low) // 2)).otherwise(0.0))
        names.append(F.when(full | part, k))
    out = docs.withColumns({"score": reduce(lambda a, b: a + b, parts, F.lit(0.0)), "matched": F.filter(F.array(*names), lambda x: x.isNotNull())})
    return out.where("score > 0").orderBy(F.desc("score"), "id").limit(n)


def search_any(df: DataFrame, keyword: str, cols: list[str], limit: int = 10, order: str = "id") -> DataFrame:
    low = F.lit(keyword.lower())
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), low) for c in cols])
    return df.where(hit).orderBy(order).limit(limit)


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared words / all words of two texts."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    x, y = words(a), words(b)
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(x) + F.size(y) - both).cast("double")), F.lit(0.0))


def rank_similar(df: DataFrame, query: str, keywords: list[str], k: int = 10, weights: tuple[float, float] = (0.3, 0.5), least: float = 0.1) -> DataFrame:
    """Rows (id, title, content, tags) by 0.3 per keyword among the tags, 0.5 if the title holds the query, and the word
    similarity of the content; above `least`, the k best, ties by id."""
    tags = F.size(F.array_intersect("tags", F.array(*[F.lit(w) for w in keywords])))
    title = F.when(F.contains(F.lower("title"), F.lit(query.lower())), weights[1]).otherwise(0.0)
    out = df.withColumn("score", tags * weights[0] + title + token_jaccard(F.col("content"), F.lit(query)))
    return out.where(F.col("score") > least).orderBy(F.desc("score"), "id").limit(k)


# Weights of a skill's maturity; any other counts as UNKNOWN_MATURITY.
MATURITY = {"production": 1.0, "beta": 0.7, "prototype": 0.4, "deprecated": 0.1}
UNKNOWN_MATURITY = 0.3


@F.pandas_udf(DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of longest matching blocks of two texts in lower case; null like the empty text."""
    return pd.Series([SequenceMatcher(None, (x or "").lower(), (y or "").lower(), autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def _tag_and_name(query: str, measure: str) -> Column:
    """0.3 for each tag that holds a word (of two letters or more) of the query, and half the similarity of the query with
    name and description. measure: 'words' (token_jaccard) or 'blocks' (block_ratio, for unspaced scripts)."""
    words = [w for w in re.findall(r"\w+", query.lower()) if len(w) >= 2]
    hit = lambda t: reduce(lambda a, b: a | b, [F.contains(F.lower(t), F.lit(w)) for w in words], F.lit(False))
    tags = F.size(F.filter(F.coalesce("tags", F.array().cast("array<string>")), hit))
    own = F.concat_ws(" ", "name", "description")
    like = token_jaccard(own, F.lit(query)) if measure == "words" else block_ratio(F.lit(query), own)
    return tags * 0.3 + like * 0.5


def rank_skills(df: DataFrame, query: str, k: int = 5, measure: str = "words", least: float = 0.1) -> DataFrame:
    """Skills (id, name, description, tags, maturity, success_rate) with score: tags and name against the query, times the
    weight of the maturity, plus 0.2 of the success rate; the k best above `least`, ties by id."""
    known = F.create_map(*[x for m, w in MATURITY.items() for x in (F.lit(m), F.lit(w))])
    weight = F.coalesce(F.try_element_at(known, F.col("maturity")), F.lit(UNKNOWN_MATURITY))
    out = df.withColumn("score", _tag_and_name(query, measure) * weight + F.coalesce("success_rate", F.lit(0.0)) * 0.2)
    return out.where(F.col("score") > least).orderBy(F.desc("score"), "id").limit(k)


def rank_entities(nodes: DataFrame, edges: DataFrame, query: str, k: int = 5, measure: str = "words") -> DataFrame:
    """Entities (id, name, description, tags, confidence) with score: tags and name against the query, 0.05 for each relation
    (src, dst) at either end up to 0.3, times the confidence; the k best above 0, ties by id."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("_end")).groupBy("_end").agg(F.count("*").alias("_degree"))
    j = nodes.join(ends, nodes["id"] == ends["_end"], "left")
    score = (_tag_and_name(query, measure) + F.least(F.coalesce("_degree", F.lit(0)) * 0.05, F.lit(0.3))) * F.coalesce("confidence", F.lit(1.0))
    out = j.withColumn("score", score).drop("_end", "_degree")
    return out.where(F.col("score") > 0).orderBy(F.desc("score"), "id").limit(k)


def _masks(text: str) -> dict[str, int]:
    """For each letter a number whose bits are its places."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _longest_common(masks: dict[str, int], n: int, other: str, least: float = 0.0) -> int:
    """Length of the longest common subsequence, a bit for each place of the first text (n places); a bound from above as
    soon as it shows that the length is under `least`."""
    every = (1 << n) - 1
    open_ = every
    for a in range(0, len(other), 32):
        for c in other[a : a + 32]:
            hit = open_ & masks.get(c, 0)
            open_ = ((open_ + hit) | (open_ - hit)) & every
        bound = n - open_.bit_count() + max(0, len(other) - a - 32)
        if bound < least:
            return bound
    return n - open_.bit_count()


#: Cells that the characters of a text are counted in: what two texts have in common in cells is no less than in characters.
LETTER_CELLS, PAIR_CELLS = 64, 509
#: Texts from which on a document's are counted in cells.
MANY = 24


def dedup_text(df: DataFrame, doc: str, text: str, id: str, threshold: float = 0.8) -> DataFrame:
    """Greedy dedup inside a document: in order of id a text similar to a kept one is merged into it, and the longer of
    the two texts stays in its place (later texts are compared with the first one). Adds n_merged. Lengths, shared
    characters and pairs of neighbours (first by counts in LETTER_CELLS and PAIR_CELLS cells, of all kept texts at once; the
    bound on pairs is worked out in closetext) and the longest common subsequence bound the ratio of longest matching blocks
    from above, in this order, so only hopeless pairs are spared it."""
    fields = ", ".join(f"`{c}` {t}" for c, t in df.select(doc, id, text).dtypes)

    def near(kept: list, b: str, matcher: SequenceMatcher, own: Counter) -> bool:
        if len(kept) == 1:  # worked out for texts that are compared
            kept += [Counter(kept[0]), _masks(kept[0])]
        a, letters, masks = kept
        total = len(a) + len(b)
        if 2.0 * sum(min(n, own[c]) for c, n in letters.items()) < threshold * total or 2.0 * _longest_common(masks, len(a), b, threshold * total / 2 - 1e-9) < threshold * total:
            return False
        matcher.set_seq1(a)
        return matcher.ratio() >= threshold

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        many = len(pdf) >= MANY
        first: list[list] = []  # a text, its letters and their places
        place: dict[str, int] = {}  # of the kept texts; none is near an earlier one, so an equal text isn't either
        lengths, cells, pairs = np.zeros(16, np.int64), np.zeros((16, LETTER_CELLS), np.int32), np.zeros((16, PAIR_CELLS), np.int32)
        rows: list[list] = []
        for i, t in sorted(zip(pdf[id].tolist(), pdf[text].fillna("").tolist(), strict=True)):
            at, n = place.get(t), len(first)
            if at is None:
                if many:
                    points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
                    mine = np.bincount(points % LETTER_CELLS, minlength=LETTER_CELLS).astype(np.int32)
                    two = np.bincount((points[:-1] * 263 + points[1:]) % PAIR_CELLS, minlength=PAIR_CELLS).astype(np.int32)
                    least = threshold * (lengths[:n] + len(t)) - 1e-9
                    hopeful = np.flatnonzero(2.0 * np.minimum(lengths[:n], len(t)) >= least)
                    hopeful = hopeful[2.0 * np.minimum(cells[hopeful], mine).sum(1) >= least[hopeful]]
                    hopeful = hopeful[np.minimum(pairs[hopeful], two).sum(1) >= 1.5 * least[hopeful] - (lengths[hopeful] + len(t)) - 1 - 1e-6].tolist()
                else:
                    hopeful = [j for j in range(n) if 2.0 * min(len(first[j][0]), len(t)) >= threshold * (len(first[j][0]) + len(t))]
                if hopeful:
                    own, matcher = Counter(t), SequenceMatcher(None, "", t, autojunk=False)
                    at = next((j for j in hopeful if near(first[j], t, matcher, own)), None)
            if at is None:
                if many and n == len(lengths):
                    lengths, cells, pairs = (np.concatenate([x, np.zeros_like(x)]) for x in (lengths, cells, pairs))
                place[t] = n
                if many:
                    lengths[n], cells[n], pairs[n] = len(t), mine, two
                first.append([t])
                rows.append([pdf[doc].iloc[0], i, t, 0])
            else:
                rows[at][3] += 1
                if len(t) > len(rows[at][2]):
                    rows[at][2] = t
        return pd.DataFrame(rows, columns=[doc, id, text, "n_merged"])

    return df.select(doc, id, text).groupBy(doc).applyInPandas(run, f"{fields}, n_merged int")


def _close_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """c, d: candidates among sets (c, w) of words, each pair once; all pairs with a Jaccard similarity over the threshold
    are among them."""
    return wordsets.unpacked(wordsets.candidates(sets, threshold, 1))


def similar_pairs(df: DataFrame, id: str, text: str, threshold: float = 0.6) -> DataFrame:
    """a < b and the word Jaccard similarity above the threshold, each pair once. Exact. Texts of the same words are one
    set, compared once, and pairs of its members come out at the end. The sets are written to the shared folder."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")))
    each = df.where(F.col(id).isNotNull()).select(F.col(id).alias("i"), F.array_join(words, " ").alias("w")).where("w <> ''").withColumn("c", F.xxhash64("w"))
    sets = written(each.groupBy("c").agg(F.first("w").alias("w"), F.collect_list("i").alias("ids")), "sets", free=True)
    near = wordsets.close_pairs(sets.select("c", "w"), threshold)
    members = sets.select("c", F.explode("ids").alias("i"))
    own = sets.where(F.size("ids") > 1).select("c", F.col("c").alias("d"), F.lit(1.0).alias("similarity")) if threshold < 1 else near.limit(0)
    first, second = members.select(F.col("i").alias("p"), "c"), members.select(F.col("i").alias("q"), F.col("c").alias("d"))
    pairs = near.unionByName(own).join(first, "c").join(second, "d").where("c <> d AND p <> q OR p < q")
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "similarity")


#: Pairs that meet on a tag, of which a task counts about so many.
TASK_PAIRS = 2_000_000


def tag_pairs(df: DataFrame, id: str, tags: str, min_shared: int = 2) -> DataFrame:
    """a < b with at least so many shared tags, these and their number. Pairs are dealt before they are counted, to as many
    tasks as their number asks for: a count ahead of the shuffle would hold most pairs in every task."""
    t = df.select(F.col(id).alias("i"), F.explode(F.array_distinct(tags)).alias("t"))
    met = t.groupBy("t").agg(F.count("*").alias("f")).agg(F.sum(F.expr("f * (f - 1) div 2"))).first()[0] or 0
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), met // TASK_PAIRS + 1)
    j = t.select(F.col("i").alias("a"), "t").join(t.select(F.col("i").alias("b"), "t"), "t").where("a < b").repartition(tasks, "a", "b")
    return j.groupBy("a", "b").agg(F.count("*").alias("n_shared"), F.sort_array(F.collect_list("t")).alias("shared")).where(F.col("n_shared") >= min_shared)


#: Vectors of a block, as a rule, and rows of it that are multiplied at once.
BLOCK_VECTORS, STRIP = 8192, 512


def near_dup_vectors(df: DataFrame, owner: str, v: str, id: str, threshold: float = 0.95) -> DataFrame:
    """owner, a < b, similarity of vectors of one owner with a cosine above the threshold. Exact.

    An owner's vectors are dealt to blocks, and every two blocks meet in a group of their own as a product of matrices, strip
    by strip. The work is quadratic in an owner's vectors, as the result may be; a group's memory doesn't grow. Null vectors
    and those of length 0 are like none, and so are vectors of different dimensions.
    """
    rows = df.where(F.col(owner).isNotNull() & F.col(id).isNotNull() & F.col(v).isNotNull()).select(F.col(owner).alias("o"), F.size(v).alias("dims"), F.col(id).alias("i"), F.col(v).cast("array<double>").alias("v"))
    blocks = rows.groupBy("o", "dims").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("blocks"))
    own = rows.join(small(blocks), ["o", "dims"]).withColumn("own", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int"))
    dealt = own.select("o", "dims", "i", "v", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("o", "dims", "i", "v", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    kinds = dict(rows.dtypes)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        def side(of: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            of = of.sort_values("i")
            m = np.array(of["v"].tolist(), np.float64).reshape(len(of), -1)
            with np.errstate(invalid="ignore", divide="ignore"):
                return of["i"].to_numpy(), m / np.sqrt((m * m).sum(1))[:, None]

        p, q = pdf["p"].iloc[0], pdf["q"].iloc[0]
        ids, x = side(pdf[pdf["own"] == p])
        other, y = (ids, x) if p == q else side(pdf[pdf["own"] == q])
        a, b, found = [], [], []
        for at in range(0, len(ids), STRIP):
            like = x[at : at + STRIP] @ y.T
            r, c = np.nonzero(like > threshold)
            first, second = ids[at + r], other[c]
            keep = first < second if p == q else first != second
            a.append(np.minimum(first, second)[keep])
            b.append(np.maximum(first, second)[keep])
            found.append(like[r, c][keep])
        empty = [np.zeros(0)]
        out = pd.DataFrame({"a": np.concatenate(a or empty), "b": np.concatenate(b or empty), "similarity": np.concatenate(found or empty)})
        return out.assign(o=pdf["o"].iloc[0])[["o", "a", "b", "similarity"]]

    found = dealt.groupBy("o", "dims", "p", "q").applyInPandas(meet, f"o {kinds['o']}, a {kinds['i']}, b {kinds['i']}, similarity double")
    return found.select(F.col("o").alias(owner), "a", "b", "similarity")


def resolve_duplicates(pairs: DataFrame, ranked: DataFrame) -> DataFrame:
    """removed, kept, similarity: of each pair (a, b) the one of lower (importance, accessed_count, -id) goes; a removed
    row names its most similar better one."""
    score = lambda p: ranked.select(F.col("id").alias(p), F.struct("importance", "accessed_count", (-F.col("id")).alias("o")).alias(f"s_{p}"))
    j = pairs.join(score("a"), "a").join(score("b"), "b")
    lose = F.col("s_a") < F.col("s_b")
    out = j.select(F.when(lose, F.col("a")).otherwise(F.col("b")).alias("removed"), F.when(lose, F.col("b")).otherwise(F.col("a")).alias("kept"), "similarity")
    return out.groupBy("removed").agg(F.max_by("kept", F.struct("similarity", -F.col("kept"))).alias("kept"), F.max("similarity").alias("similarity"))
