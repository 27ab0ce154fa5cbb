"""Which documents are right for a query: groups, components, maps of ids and structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.joins import join_counted
from docloom.operators.numbering import checkpointed, in_order, last_wins


def query_sets(rows: DataFrame) -> DataFrame:
    """(query, positives) of rows(query, text_id): the sorted set of each query's ids."""
    return rows.groupBy("query").agg(F.array_sort(F.collect_set("text_id")).alias("positives"))


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges(u, v) after a large or a small star. Large: the neighbours of a node that are greater than it go to the least
    of its neighbours and itself. Small: a node and its lesser neighbours go to the least of these. Hubs stay split."""
    if large:
        both = checkpointed(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    facts = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"), F.count("*").alias("n")))
    met = join_counted(both, facts, "u", "n")
    moved = met.where("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(facts.select("u", F.col("m").alias("v")))
    return checkpointed(moved.where("u <> v").distinct())


def star_components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, component) of every end of edges(u, v): alternating large and small stars until each node hangs on the least
    of its component. A round counts a node's edges with partial sums and joins hubs by broadcast."""
    ends = edges.select(F.col("u").alias("id")).unionByName(edges.select(F.col("v").alias("id"))).distinct()
    live, before = checkpointed(edges.select("u", "v").where("u <> v").distinct()), None
    for _ in range(most_rounds):
        live = _stars(_stars(live, True), False)
        mark = tuple(live.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if mark == before:
            return checkpointed(ends.join(live.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("component")))
        before = mark
    raise RuntimeError("components did not settle")


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, component) of a bipartite edge list(id, group): ids that share a group, or are linked through others, share
    a component, named by its least id. A group becomes a star around its least id, never links between all its ids."""
    edges = checkpointed(edges.select("id", "group").distinct())
    facts = checkpointed(edges.groupBy("group").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    star = join_counted(edges, facts, "group", "n").select(F.col("id").alias("u"), F.col("least").alias("v"))
    return star_components(star, most_rounds)


def linked(labels: DataFrame, edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """labels(id, component), as components() gave them, after more edges(u, v), between known ids and new ones: only the
    components that the edges touch are joined."""
    named = edges.select("u", "v")
    for end in ("u", "v"):
        named = named.join(labels.select(F.col("id").alias(end), F.col("component").alias(f"{end}_c")), end, "left")
    touched = named.select(F.coalesce("u_c", "u").alias("u"), F.coalesce("v_c", "v").alias("v"))
    moved = star_components(touched, most_rounds)
    sizes = labels.groupBy("component").agg(F.count("*").alias("n")).join(moved.select(F.col("id").alias("component"), F.col("component").alias("new")), "component")
    sizes = checkpointed(sizes.where("component <> new"))
    changed = join_counted(labels, sizes, "component", "n").select("id", F.col("new").alias("component"))
    same = labels.join(sizes.select("component"), "component", "left_anti").select("id", "component")
    fresh = moved.join(labels.select("id"), "id", "left_anti").select("id", "component")
    return checkpointed(changed.unionByName(same).unionByName(fresh))


def multilabel_stats(sets: DataFrame) -> DataFrame:
    """One row: groups of more than one id, the largest of them (1 if none), ids in them."""
    n = F.size("positives")
    return sets.agg(F.count_if(n > 1).alias("n_groups"), F.coalesce(F.max(F.when(n > 1, n)), F.lit(1)).alias("largest"), F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("n_ids"))


def positive_map(rows: DataFrame) -> DataFrame:
    """(text_id, positives) of rows(pos, query, text_id): ids of a query as they first come; of an id's queries, the one that first came last wins."""
    first = rows.groupBy("query", "text_id").agg(F.min("pos").alias("pos"))
    groups = first.groupBy("query").agg(F.min("pos").alias("at"), in_order("text_id", "pos").alias("positives"))
    own = first.join(groups, "query").select("text_id", "at", "positives")
    return last_wins(own, ["text_id"], "at").select("text_id", "positives")


def attach(rows: DataFrame, positives: DataFrame) -> DataFrame:
    """rows(text_id, ...) with positives; an id without any is its own, and marked as missed."""
    got = rows.join(positives, "text_id", "left").withColumn("missed", F.col("positives").isNull())
    return got.withColumn("positives", F.coalesce("positives", F.array("text_id")))


def first_of_component(rows: DataFrame, components_: DataFrame, order: str) -> DataFrame:
    """The first row of each component; rows(id, ...)."""
    joined = rows.join(components_, "id")
    firsts = joined.groupBy("component").agg(F.min(order).alias(order))
    return joined.join(firsts, ["component", order], "left_semi")


def merge_queries(augmented: DataFrame, originals: DataFrame) -> DataFrame:
    """(numeric_id, text, is_original): augmented queries whose document is known, and each document's own query where
    none of them says the same, case and outer blanks aside."""
    known = augmented.join(originals.select("numeric_id"), "numeric_id", "left_semi")
    said = known.select("numeric_id", F.lower(F.trim("text")).alias("said")).distinct()
    own = originals.withColumn("said", F.lower(F.trim("query"))).join(known.select("numeric_id").distinct(), "numeric_id", "left_semi")
    missing = own.join(said, ["numeric_id", "said"], "left_anti")
    return known.select("numeric_id", "text", F.lit(False).alias("is_original")).unionByName(missing.select("numeric_id", F.col("query").alias("text"), F.lit(True).alias("is_original")))


def with_structures(docs: DataFrame, structures: DataFrame) -> DataFrame:
    """(text_id, structures): the sorted set of structures of any of a document's keys; docs(text_id, keys), structures(key, structure)."""
    keys = docs.select("text_id", F.explode_outer("keys").alias("key")).join(structures, "key", "left")
    return keys.groupBy("text_id").agg(F.array_sort(F.collect_set("structure")).alias("structures"))


def merge_structure(rows: DataFrame, by_url: DataFrame, legacy: DataFrame) -> DataFrame:
    """rows(row_no, url, text_ids) with structure (by the row's URL), positives (by its ids over the legacy bridge, the
    own structure first) and reason, null where nothing is missing. by_url(url, structure), legacy(text_id, url)."""
    own = rows.join(by_url, "url", "left").withColumnRenamed("structure", "own")
    hop = legacy.join(by_url, "url").select("text_id", "structure")
    bridged = rows.select("row_no", F.explode("text_ids").alias("text_id")).join(hop, "text_id", "left")
    sets = bridged.groupBy("row_no").agg(F.array_sort(F.collect_set("structure")).alias("bridged"), F.count_if(F.col("structure").isNull()).alias("unbridged"))
    got = own.join(sets, "row_no", "left").withColumn("bridged", F.coalesce("bridged", F.array().cast("array<string>")))
    positives = F.when(F.col("own").isNotNull(), F.array_union(F.array("own"), F.col("bridged"))).otherwise(F.col("bridged"))
    reason = F.when(F.col("own").isNull(), "no_structure").when(F.coalesce("unbridged", F.lit(0)) > 0, "no_bridge")
    return got.select("row_no", "url", F.col("own").alias("structure"), positives.alias("positives"), reason.alias("reason"))


def single_urls(docs: DataFrame) -> DataFrame:
    """(text_id, url) of ids that have exactly one URL; docs(text_id, url)."""
    got = docs.where("url <> ''").groupBy("text_id").agg(F.collect_set("url").alias("urls"))
    return got.where(F.size("urls") == 1).select("text_id", F.get("urls", F.lit(0)).alias("url"))


def pairs_to_url(pairs: DataFrame, urls: DataFrame) -> DataFrame:
    """pairs(query_key, chosen, rejected) with chosen_url, rejected_url and status (ok, unmapped or same)."""
    one = pairs.join(urls.select(F.col("text_id").alias("chosen"), F.col("url").alias("chosen_url")), "chosen", "left")
    two = one.join(urls.select(F.col("text_id").alias("rejected"), F.col("url").alias("rejected_url")), "rejected", "left")
    status = F.when(F.col("chosen_url").isNull() | F.col("rejected_url").isNull(), "unmapped").when(F.col("chosen_url") == F.col("rejected_url"), "same").otherwise("ok")
    return two.withColumn("status", status)


def relabel(queries: DataFrame, docs: DataFrame, explicit: DataFrame) -> DataFrame:
    """queries(query_key, target, url, positives) with chosen, relabelled positives and agrees: the target's only
    structure, those of all positives, the explicit ones of the URL, the chosen one first; and whether the structure
    of the query's URL is the chosen one. docs(text_id, url, structure), explicit(url, positives)."""
    of_doc = docs.groupBy("text_id").agg(F.array_sort(F.collect_set("structure")).alias("s"))
    chosen = queries.join(of_doc.withColumnRenamed("text_id", "target"), "target", "left").withColumn("chosen", F.when(F.size("s") == 1, F.get("s", F.lit(0)))).drop("s")
    via = queries.select("query_key", F.explode("positives").alias("text_id")).join(docs.select("text_id", "structure"), "text_id").groupBy("query_key").agg(F.array_sort(F.collect_set("structure")).alias("via"))
    by_url = docs.groupBy("url").agg(F.min("structure").alias("by_url"))
    got = chosen.join(via, "query_key", "left").join(explicit.withColumnRenamed("positives", "extra"), "url", "left").join(by_url, "url", "left")
    none = F.array().cast("array<string>")
    union = F.array_union(F.array_union(F.array_compact(F.array("chosen")), F.coalesce("via", none)), F.coalesce("extra", none))
    return got.select("query_key", "chosen", union.alias("positives"), F.coalesce(F.col("by_url") == F.col("chosen"), F.lit(False)).alias("agrees"))


def joined(c: str) -> Column:
    return F.array_join(c, " ")
