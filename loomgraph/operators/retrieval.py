"""Finding types, examples, places and candidates for a question or a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import block_keys, without_marks
from ..functions.schema_text import singular
from ..model import closure


def named_types(question: Column, names: list[str]) -> Column:
    """Sorted names of types that a question mentions, in singular or plural, or word for word."""
    low = F.lower(question)
    words = F.transform(F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: singular(w))
    return F.array_sort(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.array_contains(words, singular(n)) | ((F.length(n) > 2) & low.contains(F.lower(n)))))


def few_examples(scored: DataFrame, key: str, group: str, tag: str, own_group, k: int = 3, pool: int = 10, too_near: float = 0.90, own_near: float = 0.75, own_weight: float = 0.9) -> DataFrame:
    """(key, score): of the `pool` most similar examples none that gives the answer away, those of the asked group only if less similar and for less, one of each tag before a second of any."""
    top = scored.orderBy(F.desc("score"), key).limit(pool)
    own = F.col(group) == F.lit(own_group)
    kept = top.filter((F.col("score") < too_near) & (~own | (F.col("score") < own_near))).withColumn("score", F.when(own, F.col("score") * own_weight).otherwise(F.col("score")))
    turn = F.row_number().over(Window.partitionBy(tag).orderBy(F.desc("score"), key))
    return kept.withColumn("_turn", turn).orderBy("_turn", F.desc("score"), key).limit(k).select(key, "score")


def top_attributes(attributes: DataFrame, type_name: str, score: str, large: int = 200, keep: int = 50) -> DataFrame:
    """All attributes of a type, or the `keep` best where it has more than `large`."""
    n = attributes.groupBy(type_name).agg(F.count("*").alias("_n"))
    ranked = attributes.withColumn("_i", F.row_number().over(Window.partitionBy(type_name).orderBy(F.desc(score), "name")))
    return ranked.join(n, type_name).filter((F.col("_n") <= large) | (F.col("_i") <= keep)).drop("_n", "_i")


def merged_layers(base: DataFrame, overlay: DataFrame, key: str, checked: str, stale_before: Column) -> DataFrame:
    """Entries of a catalogue with those of the overlay in place of the base's, and whether they have been checked lately."""
    both = base.join(overlay.select(key), key, "left_anti").withColumn("layer", F.lit("base")).unionByName(overlay.withColumn("layer", F.lit("overlay")))
    return both.withColumn("stale", F.coalesce(F.col(checked) < stale_before, F.lit(True)))


def changed_embeddings(types: DataFrame, index: DataFrame, key: str, text: str) -> DataFrame:
    """(key, action): types to embed because they are new or their text is another, those to keep and those to drop."""
    t, i = types.select(key, F.md5(text).alias("_h")), index.select(key, F.col("hash").alias("_old"))
    return t.join(i, key, "full_outer").select(key, F.when(F.col("_h").isNull(), "drop").when(F.col("_old").isNull(), "new").when(F.col("_h") != F.col("_old"), "changed").otherwise("keep").alias("action"))


def type_cascade(pairs: DataFrame, cache: DataFrame, same: float = 0.92, different: float = 0.55) -> DataFrame:
    """(proposed, existing, verdict, by): by the cache of verdicts, else by similarity; what lies between is for a judge to decide."""
    out = pairs.join(cache.select("proposed", "existing", F.col("verdict").alias("_v")), ["proposed", "existing"], "left")
    verdict = F.coalesce("_v", F.when(F.col("score") >= same, "same").when(F.col("score") < different, "different"))
    return out.select("proposed", "existing", F.coalesce(verdict, F.lit("undecided")).alias("verdict"), F.when(F.col("_v").isNotNull(), "cache").when(verdict.isNotNull(), "similarity").otherwise("judge").alias("by"))


#: Parts of attributes' names that tell what kind of signal they hold.
SIGNALS = {"email": ("email", "e-mail", "e_mail", "mail_address"), "phone": ("phone", "mobile", "tel", "contact_number"), "address": ("address", "street", "addr"), "dob": ("dob", "birth", "date_of_birth")}
WHOLE_NAMES = ("guest_name", "full_name", "member_name", "contact_name", "customer_name", "name")
FIRST_NAMES, LAST_NAMES = ("first_name", "given_name", "firstname", "forename"), ("last_name", "family_name", "surname", "lastname")


def signals(cells: DataFrame, entity: str) -> DataFrame:
    """Per entity of (entity, name, value): name (first and last name where they are apart), mails (sorted, without repeats), phone, address, birth date. One aggregation."""
    n, v = F.lower("name"), F.when(F.trim("value") != "", F.trim("value"))
    has = lambda parts: F.greatest(*[n.contains(p) for p in parts]) if len(parts) > 1 else n.contains(parts[0])
    pick = lambda parts: F.min_by(v, F.when(has(parts) & v.isNotNull(), n))
    out = cells.groupBy(entity).agg(
        pick(FIRST_NAMES).alias("_f"), pick(LAST_NAMES).alias("_l"), F.min_by(v, F.when(has(WHOLE_NAMES) & ~has(FIRST_NAMES) & ~has(LAST_NAMES) & v.isNotNull(), n)).alias("_n"),
        F.array_sort(F.collect_set(F.when(has(SIGNALS["email"]), F.lower(v)))).alias("emails"), *[pick(SIGNALS[s]).alias(s) for s in ("phone", "address", "dob")],
    )
    both = F.when(F.col("_f").isNotNull() | F.col("_l").isNotNull(), F.concat_ws(" ", "_f", "_l"))
    return out.select(entity, F.coalesce(both, "_n", F.col(entity).cast("string")).alias("name"), "emails", "phone", "address", "dob")


def candidates(incoming: DataFrame, known: DataFrame, limit: int = 50) -> DataFrame:
    """(id, candidate, shared): for each incoming record the known ones that share most blocking keys, at most `limit`: a look-up's answer. records: id, name, phone, email, dob (normalised)."""
    keys = lambda d, i: d.select(F.col("id").alias(i), F.explode(block_keys(F.col("name"), F.col("phone"), F.col("email"), F.col("dob"))).alias("key"))
    met = keys(incoming, "id").join(keys(known, "candidate"), "key").filter("id <> candidate").groupBy("id", "candidate").agg(F.count("*").alias("shared"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("shared"), "candidate"))
    return met.withColumn("_r", rank).filter(F.col("_r") <= limit).drop("_r")


def deepest_config(types: DataFrame, tree: DataFrame, configs: DataFrame) -> DataFrame:
    """(s, type, config): of each entity's types and the classes above them, the deepest one that has a configuration; the least name among equals. tree: (src, dst) class to parent."""
    up = closure(tree)
    depth = up.groupBy(F.col("src").alias("type")).agg(F.max("depth").alias("deep"))
    above = types.select("s", "type").unionByName(types.join(up.select(F.col("src").alias("type"), "dst"), "type").select("s", F.col("dst").alias("type"))).distinct()
    met = above.join(configs, "type").join(depth, "type", "left")
    return met.groupBy("s").agg(F.min_by(F.struct("type", "config"), F.struct(-F.coalesce("deep", F.lit(0)), F.col("type"))).alias("b")).select("s", F.col("b.type").alias("type"), F.col("b.config").alias("config"))


def fold_place(c: Column) -> Column:
    """A place's name without case, marks and punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(without_marks(c), r"[^\p{L}\p{N} ]", " "), " +", " "))


def geocode(texts: DataFrame, key: str, text: str, gazetteer: DataFrame) -> DataFrame:
    """(key, place, lon, lat): the place of each free text `name` or `name, qualifier`: of those of that name, and qualifier if there is one, the most populous. gazetteer: place, name, qualifier, population, lon, lat."""
    q = texts.select(key, fold_place(F.substring_index(text, ",", 1)).alias("n"), fold_place(F.when(F.col(text).contains(","), F.substring_index(text, ",", -1)).otherwise(F.lit(""))).alias("q"))
    g = gazetteer.select("place", fold_place(F.col("name")).alias("n"), fold_place(F.coalesce("qualifier", F.lit(""))).alias("gq"), "population", "lon", "lat")
    met = q.filter("n <> ''").join(g, "n").filter("q = '' OR q = gq")
    best = F.max_by(F.struct("place", "lon", "lat"), F.struct(F.col("population"), F.col("place")))
    return met.groupBy(key).agg(best.alias("b")).select(key, "b.place", "b.lon", "b.lat")


def spatial_intent(c: Column) -> Column:
    """Struct of kind (radius, near), metres and place of a question that asks for what is around a place; null for others."""
    pattern = r"(?i)\bwithin\s+(\d+(?:\.\d+)?)\s*(km|kilomet(?:er|re)s?|m|met(?:er|re)s?|mi|miles?)\s+of\s+(.+?)\s*[?.!]*$"
    unit = F.lower(F.regexp_extract(c, pattern, 2))
    factor = F.when(unit.startswith("km") | unit.startswith("kilo"), 1000.0).when(unit.startswith("mi"), 1609.344).otherwise(1.0)
    near = r"(?i)\b(?:near|close to|around)\s+(.+?)\s*[?.!]*$"
    return F.when(c.rlike(pattern), F.struct(F.lit("radius").alias("kind"), (F.regexp_extract(c, pattern, 1).cast("double") * factor).alias("metres"), F.regexp_extract(c, pattern, 3).alias("place"))).when(c.rlike(near), F.struct(F.lit("near").alias("kind"), F.lit(None).cast("double").alias("metres"), F.regexp_extract(c, near, 1).alias("place")))
