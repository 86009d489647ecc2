"""From mentions to a book's characters: keys, what is generic, edges, clusters, and merges that a provider proposes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.strings import generic_alias, normal_name
from loomline.operators import graph, identity
from loomline.operators.cut import written

PAYLOAD_CHARS = 160_000  # fixed: clusters whose summary is longer are not sent to a provider
EVIDENCE = 4
CHARACTER = "name string, aliases array<string>, gender string, approx_age string, description string, evidence array<string>"


def clustered(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((entry_id, cluster_id), generic keys) of mentions (entry_id, name, aliases): entries that share a key which isn't
    generic belong together, and so do those whose names are nearly the same. cluster_id is the smallest entry_id."""
    keys = written(identity.mention_keys(mentions), "keys")
    generic = written(identity.generic_keys(mentions, keys), "generic")
    exact = identity.exact_edges(keys.join(generic, "key", "left_anti"))
    names = mentions.select("entry_id", normal_name(F.col("name")).alias("norm"))
    # equal names hang on their first entry, which stands for them in the pass over nearly equal ones
    first = names.where(F.length("norm") >= identity.SHORTEST).groupBy("norm").agg(F.min("entry_id").alias("b"))
    same = names.join(first, "norm").where("entry_id <> b").select(F.col("entry_id").alias("a"), "b")
    edges = exact.select("a", "b").unionByName(same).unionByName(identity.fuzzy_edges(names))
    found = graph.components(mentions.select(F.col("entry_id").alias("node")), edges)
    return found.select(F.col("node").alias("entry_id"), F.col("component").alias("cluster_id")), generic


def cluster_aliases(members: DataFrame, canonical: DataFrame, generic: DataFrame) -> DataFrame:
    """(cluster_id, aliases) of members (cluster_id, entry_id, name, aliases) with canonical (cluster_id, canonical): every
    other form of a name, without regard to case, the first one seen; no pronouns, generic keys or mere descriptors."""
    forms = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    each = members.select("cluster_id", "entry_id", F.posexplode(forms).alias("place", "form"))
    each = each.withColumn("key", normal_name(F.col("form"))).where((F.col("key") != "") & ~F.col("key").isin(identity.PRONOUNS) & ~generic_alias(F.col("form")))
    first = each.groupBy("cluster_id", "key").agg(F.min(F.struct("entry_id", "place", "form")).alias("f"))
    kept = first.join(generic, "key", "left_anti").join(canonical, "cluster_id").where(F.col("key") != normal_name(F.col("canonical")))
    held = F.transform(F.array_sort(F.collect_list("f")), lambda f: f["form"])
    return kept.groupBy("cluster_id").agg(held.alias("aliases"))


def clusters(mentions: DataFrame) -> DataFrame:
    """One row a character of mentions (entry_id, chapter_id, and a character's fields), most chapters first, then by name:
    cluster_id, name, aliases, gender, approx_age, description, evidence, occurrences, members (names) and rank.

    The name is the most frequent, then longest, then first one; gender and age are what most entries say; the
    description is the longest; evidence is the first four distinct quotes; occurrences counts chapters."""
    found, generic = clustered(mentions)
    members = written(mentions.join(found, "entry_id"), "members")
    counted = members.groupBy("cluster_id", "name").agg(F.count("*").alias("n"), F.min("entry_id").alias("first"))
    canonical = counted.groupBy("cluster_id").agg(
        F.max_by("name", F.struct("n", F.length("name"), -F.col("first"))).alias("canonical"),
        F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda x: x["name"]).alias("members"),
    )
    rest = members.groupBy("cluster_id").agg(
        F.max_by("description", F.struct(F.length("description"), -F.col("entry_id"))).alias("description"), F.count_distinct("chapter_id").alias("occurrences")
    )
    quotes = members.select("cluster_id", "entry_id", F.posexplode("evidence").alias("place", "quote"))
    quotes = quotes.groupBy("cluster_id", "quote").agg(F.min(F.struct("entry_id", "place")).alias("at"))
    quotes = quotes.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy("at"))).where(F.col("rank") <= EVIDENCE)
    quotes = quotes.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "quote"))), lambda x: x["quote"]).alias("evidence"))
    out = canonical.join(rest, "cluster_id")
    for value in ("gender", "approx_age"):
        out = out.join(identity.majority(members, "cluster_id", value, "entry_id"), "cluster_id")
    out = out.join(cluster_aliases(members, canonical.select("cluster_id", "canonical"), generic), "cluster_id", "left").join(quotes, "cluster_id", "left")
    none = F.array().cast("array<string>")
    out = out.select(
        "cluster_id", F.col("canonical").alias("name"), F.coalesce("aliases", none).alias("aliases"), "gender", "approx_age", F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("evidence", none).alias("evidence"), "occurrences", "members",
    )
    return out


def ranked(characters: DataFrame) -> DataFrame:
    """Characters by prominence: most chapters first, then by name in lower case."""
    return characters.orderBy(F.desc("occurrences"), F.lower("name"), "cluster_id")


def keys_of(characters: DataFrame) -> DataFrame:
    """characters with keys: the normalised name, aliases and members' names."""
    forms = F.concat(F.array("name"), "aliases", "members") if "members" in characters.columns else F.concat(F.array("name"), "aliases")
    return characters.withColumn("keys", F.array_distinct(F.filter(F.transform(forms, lambda x: normal_name(x)), lambda k: k != "")))


def payload(characters: DataFrame) -> DataFrame:
    """(cluster_id, item): the summary of each cluster that a provider sees, its description cut to 300 characters and its
    evidence to two quotes."""
    item = F.struct(
        "name", "aliases", "gender", "approx_age", F.col("occurrences").alias("chapters"), F.left("description", F.lit(300)).alias("description"), F.slice("evidence", 1, 2).alias("evidence")
    )
    return characters.select("cluster_id", F.to_json(item).alias("item"))


def merged(characters: DataFrame, groups: list[dict]) -> DataFrame:
    """characters after groups ({"names": [...], "canonical": ...}) were applied in their order: see identity.merged_groups
    for what is refused. The fields of a merged character come from its clusters alone, the most prominent ones first: the
    proposed name only if one of them has it, else that of the cluster with most chapters, then the longest; gender and age
    weigh each cluster by its chapters. A cast fits the driver: it is what a provider's prompt has to hold."""
    spark = characters.sparkSession
    order = Window.orderBy(F.desc("occurrences"), F.lower("name"), "cluster_id")
    held = [r.asDict() for r in keys_of(characters).withColumn("no", F.row_number().over(order)).orderBy("no").collect()]
    roots, hints = identity.merged_groups([{"id": c["no"], "keys": c["keys"], "gender": c["gender"]} for c in held], groups, hinted=True)
    pairs = spark.createDataFrame([(c["cluster_id"], c["no"], roots[c["no"]]) for c in held], "cluster_id long, no long, root long")
    named = spark.createDataFrame(list(hints.items()), "root long, hint string")
    both = keys_of(characters).join(F.broadcast(pairs), "cluster_id").join(F.broadcast(named), "root", "left")
    both = both.withColumn("hint", F.when(F.array_contains("keys", normal_name(F.col("hint"))), F.col("hint")))
    # a hint counts if any member of the group has it as a key
    both = both.withColumn("hint", F.max("hint").over(Window.partitionBy("root")))
    fused = both.groupBy("root").agg(
        F.min("cluster_id").alias("cluster_id"),
        F.coalesce(F.max("hint"), F.max_by("name", F.struct("occurrences", F.length("name"), -F.col("no")))).alias("name"),
        F.max_by("description", F.struct(F.length("description"), -F.col("no"))).alias("description"),
        F.max("occurrences").alias("occurrences"), F.count("*").alias("n_clusters"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "members"))), lambda x: x["members"])).alias("members"),
        F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "evidence"))), lambda x: x["evidence"]))), 1, EVIDENCE).alias("evidence"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", F.concat(F.array("name"), "aliases").alias("forms")))), lambda x: x["forms"])).alias("forms"),
    )
    for value in ("gender", "approx_age"):
        fused = fused.join(identity.majority(both, "root", value, "no", weight="occurrences"), "root")
    forms = fused.select("root", F.posexplode("forms").alias("place", "form")).withColumn("key", normal_name(F.col("form")))
    forms = forms.where((F.col("key") != "") & ~F.col("key").isin(identity.PRONOUNS) & ~generic_alias(F.col("form")))
    forms = forms.groupBy("root", "key").agg(F.min(F.struct("place", "form")).alias("f")).join(fused.select("root", normal_name(F.col("name")).alias("own")), "root").where("key <> own")
    aliases = forms.groupBy("root").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["form"]).alias("fused_aliases"))
    alone = characters.select("cluster_id", "aliases")
    out = fused.join(aliases, "root", "left").join(alone, "cluster_id", "left")
    final = F.when(F.col("n_clusters") == 1, F.col("aliases")).otherwise(F.coalesce("fused_aliases", F.array().cast("array<string>")))
    return out.select("cluster_id", "name", final.alias("aliases"), "gender", "approx_age", "description", "evidence", "occurrences", "members")


def merged_by_provider(characters: DataFrame, provider) -> DataFrame:
    """characters as a provider's proposal merges them; as they are where there are fewer than two, where their summary
    is too long to send, or where the provider fails. The provider takes the summary and returns JSON."""
    size, n = payload(characters).agg(F.sum(F.length("item") + 2), F.count("*")).first()
    if n < 2 or size > PAYLOAD_CHARS:
        return characters
    try:
        sent = "[" + ", ".join(r.item for r in payload(ranked(characters)).collect()) + "]"
        answer = json.loads(provider(sent))
        groups = next((answer[k] for k in ("merges", "groups", "merge_groups") if k in answer), [])
        groups = [{"names": [g["names"]] if isinstance(g.get("names"), str) else list(g.get("names") or []), "canonical": g.get("canonical") or ""} for g in groups]
    except Exception:  # noqa: BLE001 - whatever a provider does, the clusters stand
        return characters
    return merged(characters, groups)


def dispositions(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, name, disposition): clusters before (with members) kept where any of their keys is one of a final character,
    else dropped; and final characters that share no key with any cluster, which are new."""
    old = keys_of(before).select(F.lit("cluster").alias("kind"), "name", "keys")
    new = keys_of(after.drop("members")).select(F.lit("character").alias("kind"), "name", "keys")

    def met(rows: DataFrame, others: DataFrame, yes: str, no: str) -> DataFrame:
        known = others.select(F.explode("keys").alias("key")).distinct()
        each = rows.select("kind", "name", F.explode_outer("keys").alias("key")).join(known.withColumn("hit", F.lit(1)), "key", "left")
        return each.groupBy("kind", "name").agg(F.max("hit").alias("hit")).select("kind", "name", F.when(F.col("hit") == 1, yes).otherwise(no).alias("disposition"))

    return met(old, new, "kept", "dropped").unionByName(met(new, old, "matched", "new"))
