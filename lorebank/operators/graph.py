"""The knowledge graph as two tables, nodes (node_id, type, ...) and edges (src, dst, relation, seq)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from ..functions import text as T
from ..sources.scratch import dealt, written


def build(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of scored facts: a FACT, its TOPIC, SOURCE and ENTITY nodes; ABOUT, SUPPORTED_BY, SUBJECT_OF."""
    f = facts.withColumn("node", F.concat(F.lit("FACT_"), "fact_id"))
    topic = F.concat(F.lit("TOPIC_"), F.upper(T.name_to_id(F.col("topic"))))
    source = F.concat(F.lit("SOURCE_"), F.substring(F.sha2("source_url", 256), 1, 12))
    entities = f.select("node", "fact_id", F.explode(F.array_distinct(T.extract_entities(F.col("text")))).alias("name"))
    entity = F.concat(F.lit("ENTITY_"), F.regexp_replace(F.trim("name"), r"\s", "_"))
    node = lambda df, of, kind: df.select(of.alias("node_id"), F.lit(kind).alias("type"), F.col("fact_id").alias("seq"))
    every = node(f, F.col("node"), "FACT").unionByName(node(f, topic, "TOPIC")).unionByName(node(f, source, "SOURCE")).unionByName(node(entities, entity, "ENTITY"))
    # of writers of the same id the first wins, of the same fact's the first kind by name
    nodes = every.groupBy("node_id").agg(F.min_by("type", F.struct("seq", "type")).alias("type"), F.min("seq").alias("seq"))
    edge = lambda df, src, dst, relation: df.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), F.col("fact_id").alias("seq"))
    edges = edge(f, F.col("node"), topic, "ABOUT").unionByName(edge(f, F.col("node"), source, "SUPPORTED_BY")).unionByName(edge(entities, entity, F.col("node"), "SUBJECT_OF"))
    return nodes, edges


def add_questions(nodes: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, type, seq, unmapped) and edges of questions (question_id, topic, fact_ids, parent_id, refines).

    A question is ABOUT its topic and ASKS_FOR those of its facts that exist; it is unmapped if none does. It REFINES its
    parent or is DERIVED_FROM it; a null parent gives no edge.
    """
    q = questions.withColumn("node", F.concat(F.lit("QUESTION_"), "question_id"))
    edge = lambda df, dst, relation: df.select(F.col("node").alias("src"), dst.alias("dst"), relation.alias("relation"), F.col("question_id").alias("seq"))
    about = edge(q, F.concat(F.lit("TOPIC_"), F.upper(T.name_to_id(F.col("topic")))), F.lit("ABOUT"))
    facts = nodes.where("type = 'FACT'").select(F.col("node_id").alias("dst"))
    asked = q.select("node", "question_id", F.explode(F.array_distinct("fact_ids")).alias("f")).withColumn("dst", F.concat(F.lit("FACT_"), "f"))
    asks = edge(asked.join(facts, "dst", "left_semi"), F.col("dst"), F.lit("ASKS_FOR"))
    parent = edge(q.where("parent_id is not null"), F.concat(F.lit("QUESTION_"), "parent_id"), F.when(F.col("refines"), "REFINES").otherwise("DERIVED_FROM"))
    mapped = asks.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k"))
    found = q.join(mapped, "node", "left").select(F.col("node").alias("node_id"), F.lit("QUESTION").alias("type"), F.col("question_id").alias("seq"), F.col("k").isNull().alias("unmapped"))
    return found, about.unionByName(asks).unionByName(parent)


def one_hop(nodes: DataFrame, edges: DataFrame, topic: str, kind: str = "FACT") -> DataFrame:
    """Nodes of a type that are ABOUT a topic, whatever its case."""
    into = edges.where((F.col("relation") == "ABOUT") & (F.upper("dst") == f"TOPIC_{topic.upper()}")).select(F.col("src").alias("node_id"))
    return nodes.where(F.col("type") == kind).join(into, "node_id", "left_semi")


def remove(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of ``gone`` (node_id) and every edge at one of them."""
    return nodes.join(gone, "node_id", "left_anti"), edges.join(gone, edges.src == gone.node_id, "left_anti").join(gone, edges.dst == gone.node_id, "left_anti")


#: Merges of a tree up to which one task numbers it; a larger tree is numbered in rounds, as many as the logarithm of its depth.
NUMBERED = 1 << 20


def _number_trees(t: pa.Table) -> pa.Table:
    """(node, top, pre, moves) of the merges (kept, removed, at, asked) of some trees: who stands for a node in the end, its
    place if each node stands before those merged into it, these in order, and for asked nodes when they moved, the last first."""
    kept, removed, at = (t.column(c).to_pylist() for c in ("kept", "removed", "at"))
    asked = {n for n, x in zip(removed, t.column("asked").to_pylist(), strict=True) if x}
    parent = dict(zip(removed, zip(kept, at, strict=True), strict=True))
    below: dict[str, list[str]] = {}
    for _, r, k in sorted(zip(at, removed, kept, strict=True), key=lambda x: x[0]):
        below.setdefault(k, []).append(r)
    pre: dict[str, int] = {}
    top: dict[str, str] = {}
    for root in set(kept) - set(removed):
        stack = [root]
        while stack:
            n = stack.pop()
            pre[n], top[n] = len(pre), root
            stack.extend(reversed(below.get(n, [])))

    def moves(n: str) -> list[int]:
        out = []
        while n in parent:
            n, when = parent[n]
            out.append(when)
        return out[::-1]

    rows = [(n, top[n], pre[n], moves(n) if n in asked else None) for n in removed]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(t.schema.field("at").type))
    return pa.table([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["node", "top", "pre", "moves"])


def _number_rounds(merges: DataFrame) -> DataFrame:
    """The same for trees of any size, with the moves of every node and no place, by doubling the way that a node has gone."""
    now = merges.select(F.col("removed").alias("node"), F.col("kept").alias("top"), F.array("at").alias("moves"))
    while True:
        now = written(now, "moves")
        on = now.select(F.col("node").alias("top"), F.col("top").alias("next"), F.col("moves").alias("more"))
        if not now.join(on.select("top"), "top", "left_semi").limit(1).count():
            return now.select("node", "top", F.lit(0).cast("long").alias("pre"), "moves")
        whole = F.when(F.col("more").isNull(), F.col("moves")).otherwise(F.concat("more", "moves"))
        now = now.join(on, "top", "left").select("node", F.coalesce("next", "top").alias("top"), whole.alias("moves"))


def merge(nodes: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and (node_id, merged_id, at) after the ``merges`` (kept, removed, at), made one after the other in order of ``at``.

    A merge re-points the edges of the removed node, those into it before those out of it, and takes the node away. Where
    the kept node has an edge with the same two ends already, whatever its relation, a re-pointed one is dropped, and of
    several the first stays. Untouched edges stay as they are, parallel ones and loops too; an edge between the kept and
    the removed node becomes a loop. What was merged into a node stands in the third table, for nodes that remain.

    A node is removed once at most and not kept after; its keeper may be removed later, so merges are forests. Of the edges that
    end up between the same two nodes, the one stays that came there first; of those that came by the same merge the one that
    had come before it first, and so on. So edges are compared by their moves, the last first. Where one end only can move,
    that is the order of a walk through its tree, so each node has a number; where both can, the moves are compared as lists.
    Columns of ``edges``: src, dst, relation, seq; parallel edges are in the order of seq and relation. Ids without a node do no
    harm. ``at`` is a number or a text, different for each merge.
    """
    forest = written(merges.select("kept", "removed", "at"), "merges")
    kind_of_at = dict(merges.dtypes)["at"]
    tree = components(forest.select(F.col("kept").alias("a"), F.col("removed").alias("b")), "forest").toDF("removed", "tree")
    forest = written(forest.join(tree, "removed"), "forest")
    large = forest.groupBy("tree").agg(F.count("*").alias("n")).where(F.col("n") > NUMBERED).select("tree")
    small, large = forest.join(large, "tree", "left_anti"), forest.join(large, "tree", "left_semi")
    number = lambda rows: dealt(rows, "tree", forest).applyInArrow(_number_trees, f"node string, top string, pre long, moves array<{kind_of_at}>")
    placed = written(number(small.withColumn("asked", F.lit(False))), "numbered")
    if large.limit(1).count():
        placed = written(placed.unionByName(_number_rounds(large)), "numbered")

    end = lambda c, of: of.select(F.col("node").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("top", "pre", "moves")])
    joined = edges.join(end("src", placed), "src", "left").join(end("dst", placed), "dst", "left")
    touched = F.col("src_top").isNotNull() | F.col("dst_top").isNotNull()
    still = edges.join(placed.select(F.col("node").alias("src")), "src", "left_anti").join(placed.select(F.col("node").alias("dst")), "dst", "left_anti")
    moved = written(joined.where(touched).withColumns({"to_src": F.coalesce("src_top", "src"), "to_dst": F.coalesce("dst_top", "dst")}), "moved")
    moved = moved.join(still.select(F.col("src").alias("to_src"), F.col("dst").alias("to_dst")), ["to_src", "to_dst"], "left_anti")

    # both ends can move: the ends of these edges need the lists of their moves
    tops = placed.select("top").distinct()
    both = written(moved.join(tops.toDF("to_src"), "to_src", "left_semi").join(tops.toDF("to_dst"), "to_dst", "left_semi"), "both")
    one = moved.join(both.select("to_src", "to_dst").distinct(), ["to_src", "to_dst"], "left_anti")
    if both.limit(1).count():
        asked = both.select(F.col("src").alias("removed")).unionByName(both.select(F.col("dst").alias("removed"))).distinct().withColumn("asked", F.lit(True))
        listed = number(small.join(asked, "removed", "left")).where("moves is not null").unionByName(placed.where("moves is not null"))
        plain = both.select("src", "dst", "relation", "seq", "to_src", "to_dst")
        both = plain.join(end("src", listed), "src", "left").join(end("dst", listed), "dst", "left").select(*both.columns)
    none = F.array().cast(f"array<{kind_of_at}>")
    a, b = F.coalesce("src_moves", none), F.coalesce("dst_moves", none)
    # at a merge that moves one end, the edge into the removed node comes before the one out of it, a loop last
    kind = lambda x: F.when(F.array_contains(a, x) & F.array_contains(b, x), 2).when(F.array_contains(a, x), 1).otherwise(0)
    history = F.sort_array(F.transform(F.array_union(a, b), lambda x: F.struct(x.alias("at"), kind(x).alias("kind"))), asc=False)
    keyed = one.withColumn("pre", F.coalesce("src_pre", "dst_pre")).unionByName(both.withColumn("pre", F.lit(0).cast("long")))
    best = keyed.withColumn("order", F.struct("pre", history.alias("history"), "seq", "relation")).groupBy("to_src", "to_dst").agg(F.min("order").alias("x"))
    new = best.select(F.col("to_src").alias("src"), F.col("to_dst").alias("dst"), "x.relation", "x.seq")
    gone = placed.select(F.col("node").alias("node_id"))
    kept = forest.select(F.col("kept").alias("node_id"), F.col("removed").alias("merged_id"), "at").join(gone, "node_id", "left_anti")
    return nodes.join(gone, "node_id", "left_anti"), still.select("src", "dst", "relation", "seq").unionByName(new), kept


def topic_counters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, fact_count, question_count, unmapped_facts, unmapped_questions) of each topic, from the nodes that are ABOUT
    it; what is unmapped is not known from the graph, and counted as 0."""
    kinds = nodes.select(F.col("node_id").alias("src"), "type")
    about = edges.where("relation = 'ABOUT'").join(kinds, "src").groupBy(F.col("dst").alias("node_id"))
    counts = about.agg(F.count_if(F.col("type") == "FACT").alias("fact_count"), F.count_if(F.col("type") == "QUESTION").alias("question_count"))
    none = F.lit(0).cast("long")
    of = nodes.where("type = 'TOPIC'").select("node_id").join(counts, "node_id", "left")
    return of.select("node_id", F.coalesce("fact_count", none).alias("fact_count"), F.coalesce("question_count", none).alias("question_count"), none.alias("unmapped_facts"), none.alias("unmapped_questions"))


def well_linked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, ok: facts with at least one entity, a topic and a source."""
    out = edges.where("relation in ('ABOUT', 'SUPPORTED_BY')").select(F.col("src").alias("node_id"), "relation")
    ends = out.unionByName(edges.where("relation = 'SUBJECT_OF'").select(F.col("dst").alias("node_id"), "relation"))
    kinds = ends.groupBy("node_id").agg(F.size(F.collect_set("relation")).alias("k"))
    return nodes.where("type = 'FACT'").join(kinds, "node_id", "left").select("node_id", (F.coalesce("k", F.lit(0)) == 3).alias("ok"))
