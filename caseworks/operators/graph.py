"""Graphs and hierarchies: op-log replay, levels, neighbours, paths, cascades, validation. Iterations are joins whose
lineage is cut by a checkpoint into spark.checkpoint.dir."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseworks.plans.shared import cut_lineage, written
from caseworks.plans.sizes import few


def replay(oplog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Current (nodes, edges) of a log (seq, op, id, type, properties, src, rel, dst).

    The last create or delete of an id decides; updates after that create are merged property by property. Of a relation
    the last relate or unrelate decides. Relations to deleted nodes stay.
    """
    life = oplog.where(F.col("op").isin("create", "delete")).groupBy("id").agg(F.max_by(F.struct("op", "type", "properties"), "seq").alias("l"), F.max("seq").alias("born"))
    alive = life.where("l.op = 'create'").select("id", "l.type", F.col("l.properties").alias("base"), "born")
    sets = oplog.where("op = 'update'").join(alive.select("id", "born"), "id").where("seq > born").select("id", "seq", F.explode("properties").alias("k", "v"))
    first = alive.where(F.col("base").isNotNull()).select("id", F.col("born").alias("seq"), F.explode("base").alias("k", "v"))
    last = sets.unionByName(first).groupBy("id", "k").agg(F.max_by("v", "seq").alias("v"))
    props = last.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))
    nodes = alive.select("id", "type").join(props, "id", "left")
    e = oplog.where(F.col("op").isin("relate", "unrelate")).groupBy("src", "rel", "dst").agg(F.max_by("op", "seq").alias("op"))
    return nodes, e.where("op = 'relate'").drop("op")


def hierarchy(items: DataFrame, id: str, parent: str, title: str, max_depth: int | None = 5) -> DataFrame:
    """id, level (0 for roots), parent_id, parent_title, path of the tree under parentless items, to max_depth levels
    (None: all)."""
    base = items.select(F.col(id).alias("id"), F.col(parent).alias("parent_id"), F.col(title).alias("title"))
    level = base.where("parent_id IS NULL").select("id", F.lit(0).alias("level"), "parent_id", F.lit(None).cast("string").alias("parent_title"), "title", F.array("id").alias("path"))
    found = [level]
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        up = level.select(F.col("id").alias("parent_id"), F.col("title").alias("parent_title"), "path")
        level = cut_lineage(base.join(up, "parent_id").where(~F.array_contains("path", F.col("id"))).select("id", F.lit(depth).alias("level"), "parent_id", "parent_title", "title", F.concat("path", F.array("id")).alias("path")))
        if level.isEmpty():
            break
        found.append(level)
    return reduce(DataFrame.unionByName, found)


def levels(items: DataFrame, id: str, parent: str) -> DataFrame:
    """id, level (0 for roots), root, status of every item, however deep its tree is.

    Pointer doubling: each item points at an ancestor; in a round it takes over that one's pointer, so the way doubles, and a
    tree of depth d is done in log2(d) rounds, of joins that only unfinished items take part in. status: 'tree'; 'orphan'
    below a parent that isn't among the items; 'cycle' on or below a cycle. The latter two have no level and no root.
    """
    base = items.select(F.col(id).alias("id"), F.col(parent).alias("parent")).where("id IS NOT NULL").groupBy("id").agg(F.min("parent").alias("parent"), F.count_if(F.col("parent").isNull()).alias("_roots"))
    base = base.select("id", F.when(F.col("_roots") == 0, F.col("parent")).alias("parent"))
    base = written(base, "items")
    roots = base.where("parent IS NULL").select("id", F.lit(0).cast("long").alias("level"), F.col("id").alias("root"), F.lit("tree").alias("status"))
    open_ = base.where("parent IS NOT NULL").select("id", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("dist"))
    done = [roots]
    for _ in range(open_.count().bit_length() + 1):
        if open_.isEmpty():
            break
        known = reduce(DataFrame.unionByName, done).select(F.col("id").alias("k"), "level", "root", "status")
        ahead = open_.select(F.col("id").alias("o"), F.col("anc").alias("next"), F.col("dist").alias("far"))
        met = written(open_.join(known, F.col("anc") == F.col("k"), "left").join(ahead, F.col("anc") == F.col("o"), "left"), "met")
        ended = met.where("k IS NOT NULL OR o IS NULL")
        if ended.isEmpty():  # in every round the open items nearest to a root end, so the others have none
            break
        done.append(ended.select("id", (F.col("level") + F.col("dist")).alias("level"), "root", F.coalesce("status", F.lit("orphan")).alias("status")))
        open_ = met.where("k IS NULL AND o IS NOT NULL").select("id", F.col("next").alias("anc"), (F.col("dist") + F.col("far")).alias("dist"))
    ring = open_.select("id", F.lit(None).cast("long").alias("level"), F.lit(None).cast(dict(base.dtypes)["id"]).alias("root"), F.lit("cycle").alias("status"))
    return reduce(DataFrame.unionByName, [*done, ring])


def neighbors(edges: DataFrame, start: DataFrame, depth: int, rel: str | None = None) -> DataFrame:
    """start, id, hops: nodes within `depth` outgoing edges of each start (id), at their fewest hops. The start itself
    appears if a way leads back."""
    e = (edges.where(F.col("rel") == rel) if rel else edges).select("src", "dst").distinct()
    frontier = start.select(F.col("id").alias("start"), F.col("id").alias("at")).distinct()
    seen = None
    for hop in range(1, depth + 1):
        step = frontier.join(e, frontier["at"] == e["src"]).select("start", F.col("dst").alias("id")).distinct()
        step = step if seen is None else step.join(seen.select("start", "id"), ["start", "id"], "left_anti")
        step = cut_lineage(step.withColumn("hops", F.lit(hop)))
        if step.isEmpty():
            break
        seen = step if seen is None else seen.unionByName(step)
        frontier = step.select("start", F.col("id").alias("at"))
    return seen if seen is not None else frontier.select("start", F.col("at").alias("id"), F.lit(0).alias("hops")).limit(0)


def shortest_path(edges: DataFrame, start: int | str, end: int | str, max_depth: int = 5, rels: list[str] | None = None) -> DataFrame:
    """hops and path (nodes) of a shortest way of one to max_depth edges; of equal ones the least path.

    Layers of nodes grow from both ends, the smaller one first, until they meet; then the least way through the layers is
    read off, a row a hop. So layers hold nodes only, and each end sees half the depth.
    """
    e = (edges.where(F.col("rel").isin(rels)) if rels else edges).select("src", "dst")
    e, kind = cut_lineage(e), dict(edges.dtypes)["src"]  # repeated edges do no harm: layers are distinct
    one = lambda x: edges.sparkSession.range(1).select(F.lit(x).cast(kind).alias("at"))
    empty = one(start).select(F.lit(0).alias("hops"), F.array("at").alias("path")).limit(0)
    out_of = {"src": ("src", "dst"), "dst": ("dst", "src")}

    def grown(layers: list[DataFrame], side: str) -> DataFrame:
        a, b = out_of[side]
        step = e.join(few(layers[-1]), F.col("at") == F.col(a)).select(F.col(b).alias("at")).distinct()
        seen = reduce(DataFrame.unionByName, layers[1:] if start == end else layers, step.limit(0))  # a ring comes back to its start
        return cut_lineage(step.join(seen, "at", "left_anti"))

    ahead, back, sizes = [one(start)], [one(end)], {"src": 1, "dst": 1}
    for hops in range(1, max_depth + 1):
        side = "src" if sizes["src"] <= sizes["dst"] else "dst"
        layers = ahead if side == "src" else back
        layers.append(grown(layers, side))
        sizes[side] = layers[-1].count()
        if not sizes[side]:
            return empty
        meet = cut_lineage(ahead[-1].join(back[-1], "at", "left_semi"))
        if not meet.isEmpty():
            break
    else:
        return empty
    ways = [meet]  # nodes of each layer ahead that lead to where the layers meet
    for layer in ahead[-2:0:-1]:
        ways.insert(0, cut_lineage(e.join(few(ways[0]), e["dst"] == ways[0]["at"], "left_semi").select(F.col("src").alias("at")).distinct().join(layer, "at", "left_semi")))
    path = [start]
    for layer in [*(ways if len(ahead) > 1 else []), *back[-2::-1]]:
        here = e.where(F.col("src") == F.lit(path[-1]).cast(kind)).select(F.col("dst").alias("at"))
        path.append(here.join(layer, "at", "left_semi").agg(F.min("at")).first()[0])
    return edges.sparkSession.range(1).select(F.lit(hops).alias("hops"), F.array(*[F.lit(x).cast(kind) for x in path]).alias("path"))


def cascade(nodes: DataFrame, edges: DataFrame, rate_changes: DataFrame, rels: tuple[str, ...] = ("requires", "depends_on"), drop: float = 0.8) -> DataFrame:
    """id, dependent, rel of every node that depends on one whose rate (id, old_rate, new_rate) fell under drop x old."""
    fell = rate_changes.where(F.col("new_rate") < F.col("old_rate") * drop).select("id", "old_rate", "new_rate")
    e = edges.where(F.col("rel").isin(*rels)).select(F.col("dst").alias("id"), F.col("src").alias("dependent"), "rel").distinct()
    return fell.join(e, "id").join(nodes.select(F.col("id").alias("dependent")), "dependent", "left_semi")


def domain_rollup(nodes: DataFrame, edges: DataFrame, rel: str = "contains", domain: str = "domain", member: str = "skill") -> DataFrame:
    """domain id and the number of member nodes it contains, where there are any."""
    d = nodes.where(F.col("type") == domain).select(F.col("id").alias("src"))
    m = nodes.where(F.col("type") == member).select(F.col("id").alias("dst"))
    e = edges.where(F.col("rel") == rel).select("src", "dst").distinct()
    return e.join(d, "src", "left_semi").join(m, "dst", "left_semi").groupBy(F.col("src").alias("domain")).agg(F.count("*").alias("n_members"))


def _settled(step: Callable[[DataFrame], DataFrame], df: DataFrame, mark: Callable[[DataFrame], object], max_rounds: int) -> DataFrame:
    """step applied until mark stays the same; an error if it still changes after max_rounds."""
    before = mark(df)
    for _ in range(max_rounds):
        df = cut_lineage(step(df))
        now = mark(df)
        if now == before:
            return df
        before = now
    raise RuntimeError(f"did not settle in {max_rounds} rounds")


def _core(edges: DataFrame, max_rounds: int) -> DataFrame:
    """Edges left when nodes without an edge in or out are taken away again and again."""

    def trim(e: DataFrame) -> DataFrame:
        both = e.select(F.col("src").alias("x")).intersect(e.select(F.col("dst").alias("x")))
        return e.join(both.withColumnRenamed("x", "src"), "src", "left_semi").join(both.withColumnRenamed("x", "dst"), "dst", "left_semi")

    return _settled(trim, edges, DataFrame.count, max_rounds)


def cyclic_nodes(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """id of the nodes that lie on a cycle: those of strongly connected components of several nodes or with a loop.

    Nodes without an edge in or out are trimmed; then every node takes the least node that reaches it as its colour, and
    the component of each colour's own node is what reaches it inside the colour. Found components are taken away and the
    rest goes on. Rounds follow the longest way in the graph; more than max_rounds is an error, never a guess.
    """
    e = cut_lineage(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    found = []
    for _ in range(max_rounds):
        e = _core(e, max_rounds)
        if e.isEmpty():
            break
        paint = lambda c: c.unionByName(e.join(c, e["src"] == c["id"]).select(F.col("dst").alias("id"), "colour")).groupBy("id").agg(F.min("colour").alias("colour"))  # noqa: B023, E731
        nodes = e.select(F.col("src").alias("id")).distinct().withColumn("colour", F.col("id"))
        colour = _settled(paint, nodes, lambda c: c.agg(F.sum(F.xxhash64("id", "colour").cast("decimal(20,0)"))).first()[0], max_rounds)
        of = lambda end: colour.select(F.col("id").alias(end), F.col("colour").alias(f"{end}_colour"))  # noqa: B023, E731
        inside = cut_lineage(e.join(of("src"), "src").join(of("dst"), "dst").where("src_colour = dst_colour").select("src", "dst", F.col("src_colour").alias("colour")))
        back = lambda r: r.unionByName(inside.join(r.withColumnRenamed("id", "dst"), ["dst", "colour"]).select(F.col("src").alias("id"), "colour")).distinct()  # noqa: B023, E731
        members = _settled(back, colour.where("id = colour"), DataFrame.count, max_rounds)
        loops = inside.where("src = dst").select(F.col("src").alias("id"))
        several = members.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1").select("colour")
        found.append(members.join(several, "colour", "left_semi").select("id").unionByName(members.join(loops, "id", "left_semi").select("id")).distinct())
        gone = members.select(F.col("id").alias("src"))
        e = cut_lineage(e.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti"))
    return reduce(DataFrame.unionByName, found) if found else e.select(F.col("src").alias("id"))


def validate_graph(nodes: DataFrame, edges: DataFrame, type_rules: DataFrame, rel_rules: DataFrame) -> DataFrame:
    """kind, id, detail of every violation.

    type_rules: type, field, rule (required, forbidden, enum), allowed (array). rel_rules: rel, from_types, to_types
    (arrays, empty for any), max_out (null for any), acyclic. Also: relations to missing nodes, end before start. Edges may
    say of which type their end is (src_type, dst_type): a node of another type under that id isn't the one meant.
    """
    n = nodes.select("id", "type", F.coalesce("properties", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("p"))
    j = n.join(type_rules, "type").withColumn("v", F.try_element_at("p", F.col("field")))
    bad = F.when((F.col("rule") == "required") & F.col("v").isNull(), "required").when((F.col("rule") == "forbidden") & F.col("v").isNotNull(), "forbidden").when((F.col("rule") == "enum") & F.col("v").isNotNull() & ~F.array_contains("allowed", F.col("v")), "enum")
    fields = j.select(bad.alias("kind"), F.col("id").cast("string").alias("id"), F.col("field").alias("detail")).where("kind IS NOT NULL")
    span = n.select("id", F.try_element_at("p", F.lit("start")).alias("s"), F.try_element_at("p", F.lit("end")).alias("e")).where("e < s").select(F.lit("end_before_start").alias("kind"), F.col("id").cast("string").alias("id"), F.col("e").alias("detail"))
    typed = {end for end in ("src", "dst") if f"{end}_type" in edges.columns}
    types = lambda end, t: nodes.select(F.col("id").alias(end), F.col("type").alias(t), *([F.col("type").alias(f"{end}_type")] if end in typed else []))
    on = lambda end: [end, f"{end}_type"] if end in typed else end
    e = edges.join(types("src", "ts"), on("src"), "left").join(types("dst", "td"), on("dst"), "left")
    e = e.join(rel_rules, "rel", "left")
    name = F.concat_ws(">", F.col("src").cast("string"), "rel", F.col("dst").cast("string"))
    any_of = lambda allowed, t: (F.size(allowed) > 0) & ~F.array_contains(allowed, F.col(t))
    kind = F.when(F.col("ts").isNull() | F.col("td").isNull(), "dangling").when(any_of("from_types", "ts") | any_of("to_types", "td"), "endpoint")
    ends = e.select(kind.alias("kind"), F.col("src").cast("string").alias("id"), name.alias("detail")).where("kind IS NOT NULL")
    many = e.where("max_out IS NOT NULL").groupBy("src", "rel", "max_out").agg(F.count("*").alias("k")).where("k > max_out").select(F.lit("cardinality").alias("kind"), F.col("src").cast("string").alias("id"), F.col("rel").alias("detail"))
    real = e.where("ts IS NOT NULL AND td IS NOT NULL") if typed else e
    ring = cyclic_nodes(real.where("acyclic")).select(F.lit("cycle").alias("kind"), F.col("id").cast("string").alias("id"), F.lit("").alias("detail"))
    return reduce(DataFrame.unionByName, [fields, span, ends, many, ring])
