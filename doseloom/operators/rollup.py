"""Substances rolled up to their base ingredients, sets of them compared, and typed names resolved step by step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolve import RATIO, local_matches, normal


def base_rows(rows: DataFrame, dim: DataFrame, substance: str) -> DataFrame:
    """rows with a column base: each base of the substance (dim: substance, bases), or itself in lower case where there is none."""
    names = dim.where(F.size("bases") > 0).select(F.col("substance").alias("_s"), F.transform("bases", lambda b: F.lower(b)).alias("_b"))
    met = rows.join(names, F.col(substance) == F.col("_s"), "left").drop("_s")
    return met.withColumn("base", F.explode(F.coalesce(F.array_distinct("_b"), F.array(F.lower(F.col(substance)))))).drop("_b")


def set_bases(sets: DataFrame, dim: DataFrame, key: str, members: str) -> DataFrame:
    """key, bases: the distinct sorted bases of all substances in an array; an empty or null array has none."""
    spread = sets.select(key, F.explode_outer(members).alias("_m"))
    rolled = base_rows(spread.where("_m is not null"), dim, "_m").groupBy(key).agg(F.array_sort(F.collect_set("base")).alias("bases"))
    return sets.select(key).distinct().join(rolled, key, "left").withColumn("bases", F.coalesce("bases", F.array().cast("array<string>")))


def set_key(names: Column) -> Column:
    """Sorted distinct names joined by bars."""
    return F.array_join(F.array_sort(F.array_distinct(names)), "|")


def set_index(labels: DataFrame, members: str, set_id: str, order: str) -> DataFrame:
    """key, set_id of each set of ingredients; of several labels the last by order counts."""
    return labels.groupBy(F.array_join(F.array_sort(members), "|").alias("key")).agg(F.max_by(set_id, order).alias(set_id))


def sets_with_bases(wanted: DataFrame, key: str, bases: str, sets: DataFrame, dim: DataFrame, members: str = "ingredient_set") -> DataFrame:
    """key, ingredient_set of the sets whose bases equal the wanted ones exactly; an equi join on the sorted bases."""
    once = sets.select(members).where(F.size(members) > 0).distinct().withColumn("_id", F.array_join(members, "\u0001"))
    rolled = set_bases(once, dim, "_id", members).withColumn("_k", F.array_join("bases", "|")).select("_id", "_k")
    have = once.join(rolled, "_id").select("_k", members)
    want = wanted.withColumn("_k", set_key(F.transform(bases, lambda b: F.lower(b)))).where("_k <> ''").select(key, "_k")
    return want.join(have, "_k").select(key, F.col(members).alias("ingredient_set")).distinct()


def plainest(sets: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """key, ingredient_set, n_sets, n_rollups: of a key's sets the one with the fewest members, then the fewest salt forms, then the first in order."""
    once = sets.select(key, "ingredient_set").distinct().withColumn("_id", F.array_join("ingredient_set", "\u0001"))
    members = once.select("_id", "ingredient_set").distinct()
    spread = members.select("_id", F.explode_outer("ingredient_set").alias("_m"))
    rolled = base_rows(spread.where("_m is not null"), dim, "_m").groupBy("_id", "_m").agg(F.array_sort(F.collect_set("base")).alias("b")).groupBy("_id").agg(F.count_if(F.col("b") != F.array(F.lower("_m"))).alias("salted"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("b")))), "|").alias("rollup"))
    met = once.join(rolled, "_id", "left")
    best = F.min_by("ingredient_set", F.struct(F.size("ingredient_set").alias("a"), F.coalesce("salted", F.lit(0)).alias("b"), "ingredient_set"))
    return met.groupBy(key).agg(best.alias("ingredient_set"), F.count("*").alias("n_sets"), F.countDistinct(F.coalesce("rollup", F.lit(""))).alias("n_rollups"))


def resolve_names(typed: DataFrame, dictionary: DataFrame, dim: DataFrame, external: DataFrame, sets: DataFrame) -> DataFrame:
    """name, status, matched_name, ingredient_set, score, reason for every distinct typed name.

    Steps, of which the first that settles a name counts: (1) the local match (operators/resolve); (2) where it is open only
    because the name stands for several sets that are one molecule in salt forms, the plainest of them; (3) a match by
    likeness gives way to an external name equal to the typed one that leads to a label; (4) an unresolved name takes its
    close external name (ratio RATIO or more) if there is one only. external: query (normalised), name, concept, rank,
    ratio, bases: answers of an outside service laid down as a table, so nothing is asked for here.
    status: matched, needs_confirmation, unresolved, matched_via_rxnorm.
    """
    local = local_matches(typed, dictionary)
    # several sets of one molecule
    open_ = local.where("status = 'needs_confirmation' and many_sets").select("name", F.explode("sets").alias("ingredient_set"))
    same = plainest(open_, dim, "name").where("n_sets > 1 and n_rollups = 1").select("name", F.col("ingredient_set").alias("_settled"), "n_sets")
    step = local.join(same, "name", "left")
    settled = F.col("_settled").isNotNull()
    step = step.select("name", F.when(settled, "matched").otherwise(F.col("status")).alias("status"), "matched_name", F.when(settled, F.col("_settled")).otherwise(F.col("ingredient_set")).alias("ingredient_set"), "score", F.when(settled, F.concat(F.lit("same molecule in "), F.col("n_sets").cast("string"), F.lit(" salt forms"))).otherwise(F.col("reason")).alias("reason"), "candidates")
    # external answers: one concept of rank 1
    answers = external.where("rank = 1").groupBy("query", "concept").agg(F.min_by(F.struct("name", "ratio", "bases"), F.struct("name")).alias("a")).select("query", "concept", "a.*")
    near = answers.where(F.col("ratio") >= RATIO)
    one = near.groupBy("query").agg(F.count("*").alias("n_close"), F.min_by(F.struct("name", "bases"), "concept").alias("a"), F.array_sort(F.collect_list("name")).alias("close"))
    exact = answers.where(normal(F.col("name")) == F.col("query")).select("query").distinct().withColumn("_exact", F.lit(True))
    fits = sets_with_bases(one.where("n_close = 1").select("query", F.col("a.bases").alias("bases")), "query", "bases", sets, dim)
    chosen = plainest(fits, dim, "query").select("query", F.col("ingredient_set").alias("_ext"))
    ext = one.join(chosen, "query", "left").join(exact, "query", "left").select("query", "n_close", F.col("a.name").alias("_ext_name"), "_ext", F.coalesce("_exact", F.lit(False)).alias("_exact"), "close")
    met = step.join(ext, normal(F.col("name")) == F.col("query"), "left")
    good = F.col("_ext").isNotNull()
    by_exact = (F.col("status") == "matched") & (F.col("score") < 1) & good & F.col("_exact")
    by_fall = (F.col("status") == "unresolved") & good
    tied = (F.col("status") == "unresolved") & (F.col("n_close") > 1)
    use = by_exact | by_fall
    out = [
        F.when(use, "matched_via_rxnorm").when(tied, "needs_confirmation").otherwise(F.col("status")).alias("status"),
        F.when(use, F.col("_ext_name")).otherwise(F.col("matched_name")).alias("matched_name"),
        F.when(use, F.col("_ext")).otherwise(F.col("ingredient_set")).alias("ingredient_set"),
        F.when(use, F.lit(0.0)).otherwise(F.col("score")).alias("score"),
        F.when(by_exact, "exact external name").when(by_fall, "external name").when(tied, "several external names").otherwise(F.col("reason")).alias("reason"),
        F.when(tied, F.array_join("close", " | ")).otherwise(F.col("candidates")).alias("candidates"),
    ]
    return met.select("name", *out)


def resolve_entries(entries: DataFrame, names: DataFrame, dim: DataFrame, labels: DataFrame, external_exact: DataFrame, key: str) -> DataFrame:
    """key, status, matched_name, ingredient_set, step of parsed entries: (1) the written generic's bases equal a label's; (2) the
    first of the names worth trying that resolves to what fits the components; (3) the written ingredients alone, if each is known;
    (4) what the first name gave.

    entries: key, parsed; names: name, status, matched_name, ingredient_set (of resolve_names); labels: ingredient_set,
    brand_names; external_exact: name (confirmed outside). Of several label sets for a written generic the one with the
    typed brand counts, then the one with most of its written words, then the plainest.
    """
    p = F.col("parsed")
    # names worth trying: generic, brand, brand with components
    both = F.when(p["brand_text"].isNotNull() & (F.size(p["components"]) > 0), F.concat_ws(" ", p["brand_text"], F.array_join(p["components"], " / ")))
    tries = F.filter(F.array(p["name_text"], p["brand_text"], both), lambda x: x.isNotNull() & (x != ""))
    base = entries.select(key, "parsed", F.posexplode_outer(tries).alias("n", "try"))
    none = F.array().cast("array<string>")
    # (1) written generics
    written = entries.where(F.size(p["components"]) > 0).select(key, p["components"].alias("components"), p["brand_text"].alias("brand"), p["name_text"].alias("name_text"), F.transform(p["components"], lambda c: F.upper(c)).alias("_up"))
    wanted = set_bases(written, dim, key, "_up")
    fits = sets_with_bases(wanted, key, "bases", labels, dim).join(written, key)
    brands = labels.groupBy("ingredient_set").agg(F.flatten(F.collect_set("brand_names")).alias("brand_names"))
    fits = fits.join(brands, "ingredient_set", "left")
    branded = F.coalesce(F.length("brand") > 0, F.lit(False)) & F.coalesce(F.contains(F.lower(F.array_join("brand_names", " ")), F.lower("brand")), F.lit(False))
    said = F.size(F.array_intersect(F.split(F.lower(F.array_join("components", " ")), " "), F.split(F.lower(F.array_join("ingredient_set", " ")), " ")))
    scored = fits.select(key, "name_text", "ingredient_set", branded.cast("int").alias("branded"), said.alias("said"))
    facts = scored.groupBy(key).agg(F.count("*").alias("sets"), F.sum("branded").alias("n_branded"), F.max("said").alias("most"))
    ranked = scored.join(facts, key)
    top = ranked.groupBy(key).agg(F.count_if(F.col("said") == F.col("most")).alias("n_top"))
    ranked = ranked.join(top, key)
    first = F.when((F.col("n_branded") == 1) & (F.col("branded") == 1), 0).when((F.col("n_branded") != 1) & (F.col("n_top") == 1) & (F.col("said") == F.col("most")), 0).otherwise(1)
    plain = plainest(scored, dim, key).select(key, F.col("ingredient_set").alias("_plain"))
    chosen = ranked.withColumn("first", first).groupBy(key).agg(F.min("first").alias("settled"), F.min_by("ingredient_set", F.struct("first", "ingredient_set")).alias("s"), F.min("name_text").alias("name_text")).join(plain, key)
    step1 = chosen.select(key, F.lit(0).alias("step"), F.lit("matched").alias("status"), F.col("name_text").alias("matched_name"), F.when(F.col("settled") == 0, F.col("s")).otherwise(F.col("_plain")).alias("ingredient_set"))
    # (2) names in turn
    met = base.join(names, normal(F.col("try")) == normal(F.col("name")), "left")
    distinct_sets = names.where("ingredient_set is not null").select("ingredient_set").distinct().withColumn("_sid", F.array_join("ingredient_set", "\u0001"))
    sizes = set_bases(distinct_sets, dim, "_sid", "ingredient_set").select("_sid", F.size("bases").alias("n_bases"))
    met = met.withColumn("_sid", F.array_join("ingredient_set", "\u0001")).join(sizes, "_sid", "left")
    parts = F.size(p["components"])
    fit = F.when(parts <= 0, True).when(parts > 1, F.col("n_bases") >= parts).otherwise(F.col("n_bases") == 1)
    tried = met.where(F.col("status").isin("matched", "matched_via_rxnorm") & F.coalesce(fit, F.lit(False)))
    step2 = tried.groupBy(key).agg(F.min_by(F.struct("status", "matched_name", "ingredient_set"), "n").alias("b")).select(key, F.lit(1).alias("step"), "b.*")
    # (3) ingredients alone
    known = dim.select(F.explode("bases").alias("name")).select(F.lower("name").alias("base")).union(external_exact.select(F.lower("name"))).distinct().withColumn("_known", F.lit(True))
    each = wanted.select(key, F.explode("bases").alias("base")).join(known, "base", "left")
    sure = each.groupBy(key).agg(F.bool_and(F.coalesce("_known", F.lit(False))).alias("ok"), F.transform(F.array_sort(F.collect_set("base")), lambda b: F.upper(b)).alias("ingredient_set")).where("ok")
    step3 = sure.join(written, key).select(key, F.lit(2).alias("step"), F.lit("matched_ingredient_only").alias("status"), F.col("name_text").alias("matched_name"), "ingredient_set")
    # (4) the first try as it came out
    step4 = met.groupBy(key).agg(F.min_by(F.struct(F.coalesce("status", F.lit("unresolved")).alias("status"), "matched_name", F.coalesce("ingredient_set", none).alias("ingredient_set")), F.coalesce("n", F.lit(0))).alias("b")).select(key, F.lit(3).alias("step"), "b.*")
    steps = step1.unionByName(step2).unionByName(step3).unionByName(step4)
    best = steps.groupBy(key).agg(F.min_by(F.struct("status", "matched_name", "ingredient_set", "step"), "step").alias("b"))
    return best.select(key, "b.*")


def attach_records(resolved: DataFrame, index: DataFrame, records: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """resolved (key, status, ingredient_set) with set_id, no_label and bases: the record of the label with exactly these ingredients;
    ingredients alone have none and are marked no_label; entries without either have null bases."""
    keyed = resolved.withColumn("_k", F.array_join(F.array_sort("ingredient_set"), "|"))
    known = records.select("set_id").distinct().withColumn("_there", F.lit(True))
    met = keyed.join(index.select(F.col("key").alias("_k"), "set_id"), "_k", "left").join(known, "set_id", "left")
    alone = F.col("status") == "matched_ingredient_only"
    found = F.col("status").isin("matched", "matched_via_rxnorm") & F.coalesce("_there", F.lit(False))
    rolled = set_bases(resolved.where(F.size("ingredient_set") > 0), dim, key, "ingredient_set")
    return met.join(rolled, key, "left").select(key, "status", "ingredient_set", F.when(found, F.col("set_id")).when(alone, F.lit("")).alias("set_id"), alone.alias("no_label"), F.when(found | alone, F.col("bases")).alias("bases"))
