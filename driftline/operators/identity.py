"""Materials: deduplication, slots, primaries, clusters, vendors and source authority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import text as T

#: Priority of sources without one in clusters and in ranking; slots of events on one material.
CLUSTER_PRIORITY = 5
UNRANKED = 99
SLOT_SIZE = 10_000
HOST_NOISE = "www com org io ai dev docs platform api".split()


def dedupe_materials(items: DataFrame, key: Column) -> DataFrame:
    """One row per key: its first arrival (``seq``) with ``seen_in``, the sources in order of arrival, without repeats."""
    first = items.withColumn("_key", key).groupBy("_key", "source_id").agg(F.min("seq").alias("_s"))
    seen = first.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_s", "source_id"))), lambda x: x["source_id"]).alias("seen_in"), F.min("_s").alias("seq"))
    return seen.withColumnRenamed("_key", "material_key")


def material_slots(items: DataFrame, url: Column) -> DataFrame:
    """Position of each material on its page, from 0, in order of arrival."""
    return items.withColumn("page", url).withColumn("slot", (F.row_number().over(Window.partitionBy("page").orderBy("seq")) - 1).cast("long"))


def corpus_key(url: Column, slot: Column, position: Column) -> tuple[Column, Column]:
    """(statement index, statement id) of the event at ``position`` of the material at ``slot``."""
    index = slot * SLOT_SIZE + position
    return index, F.concat(F.substring(F.sha2(url, 256), 1, 16), F.lit("-"), F.lpad(index.cast("string"), 6, "0"))


def clusters(items: DataFrame) -> DataFrame:
    """Two passes: same page section and text, then same vendor, type and headline signature.

    Columns: ``item_id, url, title, body, vendor, change_type, priority, published_at, source_id, seq``. Vendor, type and
    title of a section are those of its first arrival (``seq``). The primary is the item of the best priority, then the
    earliest, then by url; ``seen_in`` are the sources in order. Only aggregates of items travel, never their bodies.
    """
    sectioned = items.withColumn("_page", T.canonical_url(F.col("url"), keep_fragment=True)).withColumn("_text", F.sha2(F.substring(F.coalesce("body", F.lit("")), 1, 2000), 256))
    rank = F.struct(F.coalesce("priority", F.lit(CLUSTER_PRIORITY)).alias("p"), F.col("published_at").isNull().alias("n"), F.col("published_at").alias("at"), "url", "seq", F.col("item_id").alias("id"))
    sources = F.collect_set(F.when(F.col("source_id") != "", F.col("source_id")))
    one = sectioned.groupBy("_page", "_text").agg(F.min(rank).alias("lead"), F.min_by(F.struct("vendor", "change_type", "title"), "seq").alias("head"), F.count("*").alias("n"), sources.alias("seen"))
    signed = one.withColumn("signature", T.title_signature(F.col("head.title")))
    merged = signed.groupBy(F.col("head.vendor").alias("vendor"), F.col("head.change_type").alias("change_type"), "signature").agg(F.min("lead").alias("lead"), F.sum("n").alias("items"), F.count("*").alias("sections"), F.collect_set("seen").alias("seen"))
    id_ = T.cluster_id(F.col("vendor"), F.col("change_type"), F.col("signature"))
    return merged.select(id_.alias("cluster_id"), F.col("signature").alias("dedup_key"), "vendor", "change_type", "items", "sections", F.col("lead.id").alias("primary_id"), F.array_sort(F.array_distinct(F.flatten("seen"))).alias("seen_in"))


def in_order(found: DataFrame) -> DataFrame:
    """Clusters by id, so that a rerun prints the same sequence."""
    return found.orderBy("cluster_id")


def vendor_from_alias(names: DataFrame, aliases: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``vendor``: the exact folded alias, else for names of up to six words the longest alias contained in it.

    Each name is cut into pieces of the lengths that aliases have (a list as short as the longest alias), so containment
    is an equi-join whatever the number of aliases.
    """
    table = aliases.select(T.fold_key(F.col("alias")).alias("_a"), "vendor").filter("_a != ''").groupBy("_a").agg(F.max("vendor").alias("vendor"))
    keyed = names.withColumn("_key", T.fold_key(F.col(raw))).withColumn("_short", T.word_count(F.col(raw)) <= 6)
    distinct = keyed.select("_key", "_short").filter("_key != ''").distinct()
    n = F.length("_key")
    distinct = distinct.join(F.broadcast(table.agg(F.collect_set(F.length("_a")).alias("_lengths"))), how="cross")
    fitting = F.filter("_lengths", lambda k: k <= n)
    pieces = F.when(F.col("_short"), F.flatten(F.transform(fitting, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col("_key"), i, k))))).otherwise(F.array("_key"))
    hits = distinct.select("_key", "_short", F.explode(F.array_distinct(pieces)).alias("_a")).join(table, "_a")
    found = hits.groupBy("_key", "_short").agg(F.max_by("vendor", F.struct((F.col("_a") == F.col("_key")).alias("x"), F.length("_a").alias("n"), "_a")).alias("vendor"))
    return keyed.join(found, ["_key", "_short"], "left").drop("_key", "_short")


def vendor_from_host(pages: DataFrame, aliases: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``vendor``: the first label of the host, from the left, that is an alias."""
    host = F.lower(F.element_at(F.split(F.regexp_replace(F.coalesce(url, F.lit("")), "^https?://", ""), "/"), 1))
    table = aliases.select(T.fold_key(F.col("alias")).alias("_a"), "vendor")
    labels = pages.select(url).distinct().select(url, F.posexplode(F.filter(F.split(host, r"\."), lambda x: ~x.isin(HOST_NOISE))).alias("_pos", "_label"))
    found = labels.join(table, T.fold_key(F.col("_label")) == F.col("_a")).groupBy(url).agg(F.min_by("vendor", "_pos").alias("vendor"))
    return pages.join(found, url, "left")


def source_priority(signals: DataFrame, sources: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``source_priority``: that of the longest configured url that begins the signal's, else the best on its host.

    Every path prefix of a url is looked up by equality, so no url is compared with every source.
    """
    base = sources.filter("priority is not null").select(T.url_key(F.col("url")).alias("_base"), "priority").filter("_base != ''")
    prefix = base.groupBy("_base").agg(F.min("priority").alias("_p"))
    host = base.groupBy(F.substring_index("_base", "/", 1).alias("_host")).agg(F.min("priority").alias("_hp"))
    keys = signals.select(url).distinct().withColumn("_key", T.url_key(F.col(url)))
    steps = F.split("_key", "/")
    paths = keys.withColumn("_base", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))))
    hit = paths.join(prefix, "_base").groupBy(url).agg(F.max_by("_p", F.length("_base")).alias("_p"))
    out = signals.join(hit, url, "left").withColumn("_host", F.substring_index(T.url_key(F.col(url)), "/", 1)).join(host, "_host", "left")
    return out.withColumn("source_priority", F.coalesce("_p", "_hp")).drop("_p", "_hp", "_host")


def corroborated(items: DataFrame, best: int = 3) -> DataFrame:
    """Keys that an unflagged item of priority ``best`` or better backs."""
    return items.filter((F.col("priority") <= best) & ~F.col("requires_corroboration")).select("dedup_key").distinct()
