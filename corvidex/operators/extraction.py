"""A graph from what extractors found: nodes, edges and hyperedges under the names and ids that each of them uses.

Ids are compared as strings; an id that no node has is looked for by its key (lower case, other signs as underscores).
Nothing is held in one place: all references are made different and resolved once, then joined to edges and members.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvidex.functions import text as X
from corvidex.sources.tables import written

#: Kinds of nodes, other names of these, relations to things outside, unspecific ones, trust in a finding.
KINDS = ("code", "document", "paper", "image", "rationale", "concept")
KIND_NAMES = {"markdown": "document", "text": "document", "tool": "code", "library": "code"}
IMPORTS = ("imports", "imports_from", "re_exports")
GENERIC = ("references", "uses", "mentions")
TRUST = {"EXTRACTED": 3, "INFERRED": 2, "AMBIGUOUS": 1}


@dataclass
class Built:
    """nodes: id, label, source_file, file_type, origin, external. edges: src, dst, relation, confidence, score, weight,
    location. members: hyperedge, position, id. report: kind, n. merged: id, canonical."""

    nodes: DataFrame
    edges: DataFrame
    members: DataFrame
    report: DataFrame
    merged: DataFrame


def _first(rows: DataFrame, *names: str) -> Column:
    """The first of some columns, of those that there are, with a string that isn't blank."""
    held = {c.lower(): c for c in rows.columns}
    found = [F.col(f"`{held[n]}`").cast("string") for n in names if n in held]
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in found], F.lit(None).cast("string"))


def read_nodes(nodes: DataFrame) -> DataFrame:
    """id, label, source_file, file_type, origin; one row an id. Of repeated ids the row with the greatest ``seq`` that has
    a value gives it (without ``seq``, and between equal ones, the greatest value). Rows without an id go."""
    kind = F.coalesce(_first(nodes, "file_type"), F.lit("concept"))
    known = reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), KIND_NAMES.items(), F.when(kind.isin(*KINDS), kind))
    seq = _first(nodes, "seq").cast("double")
    rows = nodes.select(_first(nodes, "id").alias("id"), _first(nodes, "label", "name").alias("label"), _first(nodes, "source_file", "path", "source").alias("source_file"), known.otherwise("concept").alias("file_type"), _first(nodes, "origin").alias("origin"), F.coalesce(seq, F.lit(0.0)).alias("seq"))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("seq", c))).alias(c) for c in ("label", "source_file", "file_type", "origin")]
    return rows.where("id IS NOT NULL").groupBy("id").agg(*last)


def ghosts(nodes: DataFrame) -> DataFrame:
    """id, canonical: nodes with the label and file of another. A parsed one (origin ast) stands for all; without one the
    least id does; where several are parsed, nobody can say which is meant, and all stay."""
    named = nodes.where("label IS NOT NULL AND source_file IS NOT NULL").select("id", F.trim("label").alias("label"), "source_file", F.coalesce(F.col("origin") == "ast", F.lit(False)).alias("parsed"))
    groups = named.groupBy("source_file", "label").agg(F.count_if("parsed").alias("k"), F.count("*").alias("n"), F.coalesce(F.min(F.when(F.col("parsed"), F.col("id"))), F.min("id")).alias("canonical")).where("n > 1 AND k < 2")
    return named.where("NOT parsed").join(groups, ["source_file", "label"]).where("id <> canonical").select("id", "canonical")


def read_edges(edges: DataFrame) -> DataFrame:
    """src, dst, relation, confidence, score, weight, location. A number for a confidence is a score of something inferred,
    as is a score alone. A weight that is no number, not finite or negative counts as 1."""
    said, score = _first(edges, "confidence"), _first(edges, "confidence_score", "score").try_cast("double")
    number = said.try_cast("double")
    fit = lambda c: F.when(c.isNull() | F.isnan(c) | (c < 0) | (c == float("inf")), 1.0).otherwise(c)
    confidence = F.when(number.isNotNull() | (said.isNull() & score.isNotNull()), "INFERRED").otherwise(said)
    any_score = F.coalesce(score, number)
    return edges.select(_first(edges, "source", "src", "from").alias("src"), _first(edges, "target", "dst", "to").alias("dst"), _first(edges, "relation", "type").alias("relation"), confidence.alias("confidence"), F.when(any_score.isNotNull(), fit(any_score)).alias("score"), fit(_first(edges, "weight").try_cast("double")).alias("weight"), _first(edges, "source_location", "location").alias("location"))


def read_members(hyperedges: DataFrame) -> DataFrame:
    """hyperedge, position, ref: the list under nodes, members or node_ids, the first that isn't null; the first of equal
    members counts, null and blank ones go. A hyperedge without an id, or with a repeated one, goes by id."""
    held = {c.lower(): c for c in hyperedges.columns}
    lists = [F.col(f"`{held[n]}`").cast("array<string>") for n in ("nodes", "members", "node_ids") if n in held]
    each = F.array_distinct(F.filter(F.coalesce(*lists), lambda m: F.trim(m) != ""))
    return hyperedges.select(_first(hyperedges, "id").alias("hyperedge"), F.posexplode(each).alias("position", "ref"))


def _order() -> Column:
    """The greatest of a pair's edges stays: a specific relation, the last by name, the surest, one with a place, the best score."""
    trust = reduce(lambda c, kv: c.when(F.col("confidence") == kv[0], kv[1]), TRUST.items(), F.when(F.lit(False), 0)).otherwise(0)
    return F.struct(~F.coalesce(F.col("relation").isin(*GENERIC), F.lit(False)), F.coalesce("relation", F.lit("")), trust, F.col("location").isNotNull(), F.coalesce("score", F.lit(-1.0)), "weight", F.coalesce("location", F.lit("")), F.coalesce("confidence", F.lit("")))


def build(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame | None = None) -> Built:
    """The directed graph of an extraction, one edge a pair.

    An edge's end that no node has goes with the edge, unless it is what an import names: that gets a node of its own, marked
    external. Imports of oneself go, and so do edges whose ends are of two families of languages (inferred calls, if both
    ends have an extension; imports and references, if both families are known). Members that can't be found go, and
    hyperedges without a member left (one that never had a member is in no count). Columns beyond those named are left out; empty tables give an empty graph.
    """
    found = written(read_nodes(nodes), "found")
    merged = written(ghosts(found), "merged")
    kept = found.join(merged.select("id"), "id", "left_anti")
    rows = read_edges(edges)
    listed = read_members(hyperedges) if hyperedges is not None else None
    refs = rows.select(F.explode(F.array("src", "dst")).alias("ref"))
    refs = (refs.union(listed.select("ref")) if listed is not None else refs).where("ref IS NOT NULL").distinct()
    keyed = merged.select(X.key(F.col("id")).alias("key"), F.lit(0).alias("tier"), F.col("canonical").alias("id")).union(kept.select(X.key(F.col("id")), F.lit(1), "id"))
    keyed = keyed.groupBy("key").agg(F.min(F.struct("tier", "id")).alias("best")).select("key", F.col("best.id").alias("close"))
    exact = kept.select(F.col("id").alias("ref"), F.lit(True).alias("exact"))
    resolved = refs.join(exact, "ref", "left").withColumn("key", X.key(F.col("ref"))).join(keyed, "key", "left").select("ref", F.when(F.col("exact"), F.col("ref")).otherwise(F.col("close")).alias("id")).where("id IS NOT NULL")
    resolved = written(resolved.join(kept.select("id", "source_file"), "id"), "resolved")
    end = lambda c: resolved.select(F.col("ref").alias(c), F.col("id").alias(f"{c}_id"), F.col("source_file").alias(f"{c}_file"))
    joined = rows.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    imports = F.coalesce(F.col("relation").isin(*IMPORTS), F.lit(False))
    outside = imports & F.col("src_id").isNotNull() & F.col("dst_id").isNull()
    src, dst = (X.family(F.coalesce(F.col(f), F.lit(""))) for f in ("src_file", "dst_file"))
    has = lambda f: F.coalesce(X.extension(F.col(f)), F.lit("")) != ""
    guessed = (F.col("relation") == "calls") & (F.col("confidence") == "INFERRED") & has("src_file") & has("dst_file") & (src != dst)
    named = F.col("relation").isin("imports", "imports_from", "references") & (src != "other") & (dst != "other") & (src != dst)
    fate = (
        F.when(F.col("src").isNull() | F.col("dst").isNull(), "incomplete")
        .when(outside, "external")
        .when(F.col("src_id").isNull() | F.col("dst_id").isNull(), "dangling")
        .when(F.coalesce(guessed | named, F.lit(False)), "crossed")
        .when(imports & (F.col("src_id") == F.col("dst_id")), "loop")
        .otherwise("found")
    )
    judged = written(joined.select(F.col("src_id").alias("src"), F.coalesce("dst_id", "dst").alias("dst"), "relation", "confidence", "score", "weight", "location", fate.alias("fate")), "judged")
    pairs = judged.where("fate IN ('found', 'external')").groupBy("src", "dst").agg(F.max_by(F.struct("relation", "confidence", "score", "weight", "location"), _order()).alias("e")).select("src", "dst", "e.*")
    stubs = judged.where("fate = 'external'").select(F.col("dst").alias("id")).distinct()
    every = kept.withColumn("external", F.lit(False)).unionByName(stubs.select("id", F.col("id").alias("label"), F.lit("").alias("source_file"), F.lit("concept").alias("file_type"), F.lit(None).cast("string").alias("origin"), F.lit(True).alias("external")))
    counts = [judged.groupBy(F.concat(F.lit("edges "), "fate").alias("kind")).agg(F.count("*").alias("n")), merged.agg(F.lit("nodes merged").alias("kind"), F.count("*").alias("n")), stubs.agg(F.lit("nodes external"), F.count("*")), kept.agg(F.lit("nodes kept"), F.count("*"))]
    if listed is None:
        members = stubs.select(F.col("id").alias("hyperedge"), F.lit(0).alias("position"), "id").where("false")
    else:
        placed = written(listed.join(resolved.select("ref", "id"), "ref", "left"), "placed")
        members = placed.where("id IS NOT NULL").select("hyperedge", "position", "id")
        counts += [placed.groupBy(F.when(F.col("id").isNull(), "members lost").otherwise("members kept")).agg(F.count("*")), placed.groupBy("hyperedge").agg(F.count("id").alias("k")).groupBy(F.when(F.col("k") == 0, "hyperedges lost").otherwise("hyperedges kept")).agg(F.count("*"))]
    return Built(every, pairs, members, reduce(DataFrame.union, counts), merged)
