"""From mentions to characters: keys, edges, components and what a cluster of mentions is called."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.strings import digit_runs, normal_name

# Personal, possessive and reflexive pronouns, which never name anyone.
PRONOUNS = (
    "i me my mine myself you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "we us our ours ourselves they them their theirs themselves"
).split()
RATIO, SHORTEST, LENGTHS = 0.9, 4, 3  # fixed: of similar names


def mention_keys(mentions: DataFrame) -> DataFrame:
    """(entry_id, key) of mentions (entry_id, name, aliases): normalised names and aliases without pronouns."""
    every = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    keys = mentions.select("entry_id", F.explode(F.transform(every, lambda x: normal_name(x))).alias("key"))
    return keys.where((F.col("key") != "") & ~F.col("key").isin(PRONOUNS)).distinct()


def _ratio_ok(a, b):
    import pandas as pd

    def similar(x, y):
        if min(len(x), len(y)) < SHORTEST:
            return x == y
        short, long = sorted((x, y), key=len)
        return short in long or difflib.SequenceMatcher(None, x, y).ratio() >= RATIO

    return pd.Series([similar(x, y) for x, y in zip(a, b, strict=True)])


def generic_keys(mentions: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys that dissimilar names carry: not all of the names are like the longest (of equally long ones the smallest)."""
    similar = F.pandas_udf(_ratio_ok, "boolean")
    named = keys.join(mentions.select("entry_id", normal_name(F.col("name")).alias("norm")), "entry_id").select("key", "norm").distinct()
    longest = named.groupBy("key").agg(F.min_by("norm", F.struct(-F.length("norm"), "norm")).alias("base"), F.count("*").alias("names")).where("names > 1")
    judged = named.join(longest, "key").where("norm <> base").withColumn("ok", similar("norm", "base"))
    return judged.groupBy("key").agg(F.bool_and("ok").alias("ok")).where("not ok").select("key")


def exact_edges(keys: DataFrame) -> DataFrame:
    """(a, b): every entry of a key and the first one; a key's entries are never paired with one another."""
    first = keys.groupBy("key").agg(F.min("entry_id").alias("b"))
    return keys.join(first, "key").where("entry_id <> b").select(F.col("entry_id").alias("a"), "b").distinct()


PIECES = 5  # the longest piece that a name is cut into


def fuzzy_edges(names: DataFrame) -> DataFrame:
    """(a, b) of distinct names (entry_id, norm) of four letters or more that are alike: lengths within three, equal
    digit runs, ratio of at least 0.9.

    Names of n and at most n + 3 letters with that ratio leave at most k = (2 n + 3) / 10 letters of both unmatched. Each
    of them spoils one of k + 1 pieces that the first name is cut into, and moves the others by one place. So one piece
    at least stands whole in the second name, no more than k places away: pairs meet by digit runs, piece and place, and
    the ratio is asked for those alone. Pieces have two to PIECES letters."""
    ratio = F.pandas_udf(_ratio, "double")
    rows = names.where(F.length("norm") >= SHORTEST).groupBy("norm").agg(F.min("entry_id").alias("entry_id"))
    rows = rows.select("entry_id", "norm", F.array_join(digit_runs(F.col("norm")), ",").alias("digits"), F.length("norm").alias("n"))
    rows = rows.withColumn("k", F.expr(f"(2 * n + {LENGTHS}) div 10"))
    ends = F.transform(F.sequence(F.lit(0), F.col("k") + 1), lambda i: F.floor(i * F.col("n") / (F.col("k") + 1)).cast("int"))
    cut = rows.withColumn("ends", ends).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    cut = cut.select("entry_id", "norm", "digits", "n", "k", F.get("ends", "i").alias("at"), (F.get("ends", F.col("i") + 1) - F.get("ends", "i")).alias("size"))
    left = cut.withColumn("place", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("k")), F.col("at") + F.col("k"))))
    left = left.select(F.col("entry_id").alias("a"), F.col("norm").alias("x"), "digits", F.col("n").alias("nx"), F.substring("norm", F.col("at") + 1, F.col("size")).alias("piece"), "place")
    right = rows.withColumn("size", F.explode(F.sequence(F.lit(2), F.least(F.lit(PIECES), F.col("n"))))).withColumn("place", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("size"))))
    right = right.select(F.col("entry_id").alias("b"), F.col("norm").alias("y"), "digits", F.col("n").alias("ny"), F.substring("norm", F.col("place") + 1, F.col("size")).alias("piece"), "place")
    pairs = left.join(right, ["digits", "piece", "place"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("nx") - F.col("ny")) <= LENGTHS)).select("a", "b", "x", "y").distinct()
    return pairs.where(ratio("x", "y") >= RATIO).select(F.col("b").alias("a"), F.col("a").alias("b"))


def _ratio(a, b):
    import pandas as pd

    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def majority(rows: DataFrame, key: str, value: str, order: str, ignored: tuple[str, ...] = ("", "unknown"), none: str = "unknown", weight: str | None = None) -> DataFrame:
    """(key, value): the most frequent (or heaviest) value that isn't ignored; of equal ones the first seen."""
    counted = rows.where(F.col(value).isNotNull() & ~F.col(value).isin(*ignored)).groupBy(key, value).agg((F.sum(F.greatest(F.lit(1), F.col(weight))) if weight else F.count("*")).alias("n"), F.min(order).alias("first"))
    best = counted.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))
    return rows.select(key).distinct().join(best, key, "left").select(key, F.coalesce(value, F.lit(none)).alias(value))


def cluster_profiles(members: DataFrame) -> DataFrame:
    """One row a cluster of members (cluster_id, entry_no, chapter_id, name, description): the canonical name is the most
    frequent, then longest, then first; the description the longest, then first; occurrences count chapters."""
    names = members.groupBy("cluster_id", "name").agg(F.count("*").alias("n"), F.min("entry_no").alias("first"))
    canonical = names.groupBy("cluster_id").agg(F.max_by("name", F.struct("n", F.length("name"), -F.col("first"))).alias("canonical"), F.count("*").alias("n_names"))
    rest = members.groupBy("cluster_id").agg(F.max_by("description", F.struct(F.length("description"), -F.col("entry_no"))).alias("description"), F.count_distinct("chapter_id").alias("occurrences"))
    return canonical.join(rest, "cluster_id").select("cluster_id", "canonical", "n_names", "description", "occurrences")


def first_distinct(rows: DataFrame, key: str, value: str, order: str, most: int = 4) -> DataFrame:
    """(key, rank, value): a key's distinct values in the order of their first appearance, at most so many."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("first"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("first", value))).where(F.col("rank") <= most).select(key, "rank", value)


def merged_groups(clusters: list[dict], groups: list, hinted: bool = False):
    """Applies proposed merges, one after another, to clusters: dicts with id, keys, gender; groups: lists of names, or
    dicts with names and the name that is proposed for them (canonical).

    Each name belongs to the first cluster that has it as a key. A group needs two clusters or more, and is refused where
    their roots' known genders differ. Returns the root of every id, and with hinted the first proposed name of each root
    that a merge made. Proposals are few, so this runs on the driver."""
    claim, root = {}, {c["id"]: c["id"] for c in clusters}
    gender = {c["id"]: c["gender"] for c in clusters}
    hints: dict = {}
    for c in clusters:
        for k in c["keys"]:
            claim.setdefault(k, c["id"])

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for group in groups:
        names, canonical = (group["names"], group.get("canonical", "")) if isinstance(group, dict) else (group, "")
        roots = sorted({find(claim[n]) for n in (" ".join(x.lower().split()) for x in names) if n in claim})
        known = {gender[r] for r in roots} - {"unknown", "", None}
        if len(roots) < 2 or len(known) > 1:
            continue
        for r in roots[1:]:
            root[r] = roots[0]
        if canonical:
            hints.setdefault(roots[0], canonical)
    found = {c["id"]: find(c["id"]) for c in clusters}
    return (found, {find(r): n for r, n in hints.items()}) if hinted else found
