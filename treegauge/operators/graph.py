"""The link graph.  Nodes are content hashes; edges say how they are known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import paths as P, text as X
from ..joins import lookup
from ..session import cut_lineage

# Edge kind, resolution methods, and the confidence of a name.
LINK = "link"
INLINE = "md_inline"
WIKI_PATH = "md_wikilink_path"
WIKI_UNIQUE = "md_wikilink_unique"
WIKI_SAME_SUFFIX = "md_wikilink_same_ext"
STATED = (INLINE, WIKI_PATH)
DERIVED_CONFIDENCE = 0.9


def links(content: DataFrame) -> DataFrame:
    """`path, sha256, raw, is_wiki, pos` for every link in every text."""
    def tagged(found: Column, is_wiki: bool) -> Column:
        return F.transform(found, lambda raw, i: F.struct(
            raw.alias("raw"), F.lit(is_wiki).alias("is_wiki"), i.alias("pos")))

    none = F.array().cast("array<string>")
    wiki = F.when(F.contains("text", F.lit("[[")), X.wikilinks("text")).otherwise(none)
    inline = F.when(F.contains("text", F.lit("](")), X.inline_links("text")).otherwise(none)
    return (content.filter(F.col("text").isNotNull())
            .select("path", "sha256", F.explode(
                F.concat(tagged(wiki, True), tagged(inline, False))).alias("l"))
            .select("path", "sha256", "l.raw", "l.is_wiki", "l.pos"))


def _target_paths(scope_root: str | None) -> tuple[Column, Column]:
    """Up to two absolute paths a raw target may name."""
    raw = F.col("raw")
    cleaned = F.substring_index(raw, "#", 1)
    local = ~F.rlike(raw, F.lit("^(https?://|mailto:)")) & (cleaned != "")
    absolute = F.startswith(cleaned, F.lit("/"))
    first = F.when(local, P.normpath(
        F.when(absolute, cleaned)
        .otherwise(F.concat(P.dirname("path"), F.lit("/"), cleaned))))
    second = F.lit(None).cast("string") if scope_root is None else F.when(
        local & ~absolute,
        P.normpath(F.concat(F.lit(scope_root.rstrip("/") + "/"), cleaned)))
    return first, second


def _by_name(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a bare name can mean, without ever listing its candidates.

    A name is unique when the least and greatest hash agree, so two
    aggregates with map-side combining replace a set of candidates; a name
    carried by a third of all files costs one row here.
    """
    base, suffix = P.basename("path"), P.suffix("path")
    named = read.select(
        F.explode(F.array_distinct(F.array(base, P.stem("path")))).alias("name"),
        suffix.alias("name_suffix"), "sha256")
    per_suffix = named.groupBy("name", "name_suffix").agg(
        F.min("sha256").alias("lo"), F.max("sha256").alias("hi"))
    per_name = per_suffix.groupBy("name").agg(
        F.when((F.count(F.lit(1)) == 1) & (F.min("lo") == F.max("hi")),
               F.min("lo")).alias("only_sha"))
    same = per_suffix.select(
        "name", "name_suffix",
        F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("same_sha"))
    return per_name, same


def resolve(content: DataFrame, scope_root: str | None = None) -> DataFrame:
    """Every link with what became of it.

    `outcome` is stated, derived, ambiguous or outside; `dst`, `method` and
    `confidence` are set for the first two.  Rows that need no look-up get a
    key nothing has, so they spread out instead of meeting in one task.
    """
    read = content.filter(F.col("text").isNotNull())
    by_path = read.select(F.col("path").alias("key"), F.col("sha256").alias("hit"))
    first, second = _target_paths(scope_root)
    nowhere = F.concat(F.lit("\0"), F.col("path"), F.lit("\0"), F.col("pos"))
    rows = links(content).select("*", first.alias("c1"), second.alias("c2"))
    rows = (rows.withColumn("key", F.coalesce("c1", nowhere))
            .join(by_path, "key", "left").withColumnRenamed("hit", "exact").drop("key"))
    if scope_root is not None:
        rows = (rows.withColumn("key", F.when(F.col("exact").isNull(), F.col("c2")))
                .withColumn("key", F.coalesce("key", nowhere))
                .join(by_path, "key", "left")
                .withColumn("exact", F.coalesce("exact", "hit")).drop("hit", "key"))
    per_name, same = _by_name(read)
    open_name = F.col("exact").isNull() & F.col("is_wiki")
    rows = (rows.withColumn("name", F.when(open_name, F.col("raw")).otherwise(nowhere))
            .withColumn("name_suffix", P.suffix("path")))
    rows = lookup(rows, per_name.withColumn("known", F.lit(True)), ["name"])
    rows = lookup(rows, same, ["name", "name_suffix"])
    derived = F.coalesce("only_sha", "same_sha")
    stated = F.col("exact").isNotNull()
    return rows.select(
        "path", F.col("sha256").alias("src"), "raw", "is_wiki", "pos",
        F.coalesce("exact", derived).alias("dst"),
        F.when(stated, F.when(F.col("is_wiki"), F.lit(WIKI_PATH)).otherwise(F.lit(INLINE)))
        .when(F.col("only_sha").isNotNull(), F.lit(WIKI_UNIQUE))
        .when(F.col("same_sha").isNotNull(), F.lit(WIKI_SAME_SUFFIX)).alias("method"),
        F.when(stated, F.lit(1.0)).when(derived.isNotNull(), F.lit(DERIVED_CONFIDENCE))
        .alias("confidence"),
        F.when(stated, F.lit("stated")).when(derived.isNotNull(), F.lit("derived"))
        .when(F.col("known"), F.lit("ambiguous")).otherwise(F.lit("outside"))
        .alias("outcome"))


def edges(resolved: DataFrame) -> DataFrame:
    """One edge per (src, dst): the most confident, the first said on ties.

    First means by document path, wiki links before inline ones, position.
    An aggregate and not a window: repeated links combine before the shuffle.
    """
    order = F.struct(-F.col("confidence"), "path", ~F.col("is_wiki"), "pos")
    return (resolved.filter(F.col("dst").isNotNull()).groupBy("src", "dst")
            .agg(F.lit(LINK).alias("kind"), F.min_by("method", order).alias("method"),
                 F.max("confidence").alias("confidence")))


def link_tally(resolved: DataFrame) -> DataFrame:
    """Occurrences per outcome and the number of distinct edges, in one row."""
    pairs = (resolved.groupBy("src", "dst")
             .agg(*[F.count_if(F.col("outcome") == o).alias(o)
                    for o in ("stated", "derived", "ambiguous", "outside")]))
    return pairs.agg(
        F.count_if(F.col("dst").isNotNull()).alias("edges"),
        *[F.coalesce(F.sum(o), F.lit(0)).alias(o)
          for o in ("stated", "derived", "ambiguous", "outside")])


def check_edges(candidate: DataFrame) -> DataFrame:
    """Edges that may not be stored: confidence out of range or no method."""
    return candidate.filter(~F.col("confidence").between(0.0, 1.0)
                            | F.col("method").isNull() | (F.col("method") == ""))


def neighbours(all_edges: DataFrame, start: DataFrame, hops: int = 1
               ) -> tuple[DataFrame, DataFrame]:
    """Nodes reached in `hops` over out-edges, and every edge used.

    `start(node)`.  Edges back to seen nodes are used but not followed; start
    nodes are not part of the answer.  Each node is expanded once, so edges
    need no deduplication.
    """
    frontier = start.select("node").distinct()
    seen, used = frontier, None
    reached = frontier.limit(0)
    for hop in range(hops):
        # A hub's edges are split over tasks.
        step = lookup(all_edges, frontier.withColumnRenamed("node", "src"), ["src"], "inner")
        if hop + 1 < hops and hops > 2:
            step = cut_lineage(step)
        used = step if used is None else used.unionByName(step)
        frontier = (step.select(F.col("dst").alias("node")).distinct()
                    .join(seen, "node", "left_anti"))
        seen = seen.unionByName(frontier)
        reached = frontier if hop == 0 else reached.unionByName(frontier)
    return reached, used if used is not None else all_edges.limit(0)


def provenance(used: DataFrame) -> DataFrame:
    """`complete` when every edge is literally stated, else `partial`."""
    solid = (F.col("confidence") >= 1.0) & F.col("method").isin(*STATED)
    return used.agg(F.when(F.coalesce(F.bool_and(solid), F.lit(True)), F.lit("complete"))
                    .otherwise(F.lit("partial")).alias("provenance"))
