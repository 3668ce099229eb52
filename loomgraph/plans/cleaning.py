"""Screening and cleaning of values, beside SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import cleaning as cl
from ..runtime import table



def typed_literals(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "customer")
    v = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.col("c_acctbal").cast("string"), F.lit("^^http://www.w3.org/2001/XMLSchema#float"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("a^^b"), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("<entities/Customer/"), F.col("c_custkey").cast("string"), F.lit(">")))
    t = cl.typed_literal(v)
    return c.select("c_custkey", t["lexical"].alias("lexical"), cl.datatype_of_range(t["datatype"]).alias("datatype"), cl.lexical_form(v).alias("form"))


def clean_policies(spark: SparkSession, root: str) -> DataFrame:
    """Hospitals' names by a cleaning policy."""
    h = table(spark, root, "healthcare_providers").select("record_id", cl.clean_policy(cl.composed()(F.col("specialty")), casefold=True).alias("c"))
    return h.select("record_id", "c.value", "c.reason")


def placeholders(spark: SparkSession, root: str) -> DataFrame:
    """Made-up values among phones and constants."""
    h = table(spark, root, "healthcare_providers").select("phone").union(spark.createDataFrame([(x,) for x in ("000-00-0000", "(123) 456-7890", "987654", "xxxx", "TBD", "1000", "2024", "0000", "n/a ", "12-34", "xx", "111111x")], "phone string")).distinct()
    return h.filter("phone IS NOT NULL").select("phone", cl.is_placeholder(F.col("phone")).alias("made_up"))


def grounded_values(spark: SparkSession, root: str) -> DataFrame:
    """Whether words of a trial stand in its title."""
    t = table(spark, root, "clinical_trials")
    return t.select("trial_row", cl.is_grounded(F.col("condition"), F.col("title")).alias("condition"), cl.is_grounded(F.col("phase"), F.col("title")).alias("phase"), cl.name_is_grounded(F.concat(F.lit("adult_"), F.regexp_replace(F.lower("condition"), " ", "_"), F.lit("_count")), F.col("title")).alias("name"))


def cell_faults(spark: SparkSession, root: str) -> DataFrame:
    """Cells that can't be what their column says."""
    c = table(spark, root, "coffee_shops_facts").filter("attribute IN ('address', 'shop_id')").select("fact_id", "raw_value")
    odd = F.when(F.col("fact_id") % 7 == 0, "Skip to content").when(F.col("fact_id") % 7 == 1, "1998 intake").when(F.col("fact_id") % 7 == 2, "14,000 learners annually").when(F.col("fact_id") % 7 == 3, "www.shop.example").when(F.col("fact_id") % 7 == 4, "-- !").otherwise(F.col("raw_value"))
    c = c.select("fact_id", odd.alias("v"))
    return c.select("fact_id", *[cl.cell_fault(r, F.col("v")).alias(r) for r in ("name", "city", "website", "address")])


def screened_rows(spark: SparkSession, root: str) -> DataFrame:
    """Provider rows as extracted from a page: rows without a real name are dropped, cells that fail are emptied."""
    from ..operators.ingest import screen_rows

    h = table(spark, root, "healthcare_providers").select("record_id", F.when(F.col("record_id") % 50 == 0, "Contact us").otherwise(F.col("full_name")).alias("full_name"), F.when(F.col("record_id") % 11 == 0, "https://city.example").otherwise(F.col("city")).alias("city"))
    return screen_rows(h, "full_name", ["city"]).select("record_id", "full_name", "city", "scrubbed")


def alias_pairs(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "nation")
    raw = F.when(F.col("n_nationkey") % 3 == 0, F.concat("n_name", F.lit(" => N"), "n_nationkey")).when(F.col("n_nationkey") % 3 == 1, F.concat("n_name", F.lit("→"), F.lower("n_name"))).otherwise(F.concat("n_name", F.lit("=> ")))
    return n.select("n_nationkey", cl.alias_pair(raw).alias("a")).select("n_nationkey", "a.old", "a.new")


def scalar_cells(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "coffee_shops").select("row_no", F.to_json(F.struct(F.col("parent_chain").alias("list"), F.concat(F.lit(" "), "id", F.lit(" ")).alias("text"), F.col("row_no").alias("n"), F.struct("id").alias("object"), (F.col("row_no") % 2 == 0).alias("flag"))).alias("j"))
    raw = F.from_json("j", "list string, text string, n string, object string, flag string")
    quoted = lambda c: F.when(c.isNotNull(), F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6))
    r = s.select("row_no", raw.alias("r"))
    return r.select("row_no", cl.scalar_cell(F.col("r.list")).alias("list"), cl.scalar_cell(quoted(F.col("r.text"))).alias("text"), cl.scalar_cell(F.col("r.n")).alias("n"), cl.scalar_cell(F.col("r.object")).alias("object"), cl.scalar_cell(F.col("r.flag")).alias("flag"))


def label_ladder(spark: SparkSession, root: str) -> DataFrame:
    """Ever shorter forms of models' names with codes at their ends."""
    m = table(spark, root, "llm_models")
    label = F.concat_ws(" ", "organization", F.when(F.col("open_source"), F.lit("Model")), "display_name", F.concat(F.lit("X-"), F.coalesce(F.col("context_length"), F.lit(0)).cast("string")), F.lit("33"))
    return m.select("model_id", F.posexplode(cl.label_candidates(label)).alias("step", "label"))


def loose_matches(spark: SparkSession, root: str) -> DataFrame:
    """Spellings of a hospital that differ from those of the same phone by more than case and parts."""
    h = table(spark, root, "healthcare_providers").filter("phone IS NOT NULL AND hospital_affiliation IS NOT NULL").groupBy("phone").agg(F.min("hospital_affiliation").alias("a"), F.max("hospital_affiliation").alias("b"))
    return h.groupBy(cl.loosely_equal(F.col("a"), F.col("b")).alias("same")).agg(F.count("*").alias("n"))


def lookup_keys(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "healthcare_providers").groupBy(cl.lookup_key(F.col("city"), 2).alias("key")).agg(F.count("*").alias("n"))


def envelope_ids(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "part")
    return p.select("p_partkey", cl.envelope_id(F.lit("run|1"), F.col("p_brand"), F.array(F.col("p_type"), F.col("p_name")), F.col("p_partkey").cast("string")).alias("fact_id"))


def safe_iris(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "known_terms")
    return t.select("term_id", cl.safe_iri(F.concat(F.lit("https://graph.invalid/"), "term")).alias("raw"), cl.safe_iri(F.concat(F.lit("https://graph.invalid/"), F.regexp_replace("term", r"\s", "_"))).alias("joined"))


def tolerant_json(spark: SparkSession, root: str) -> DataFrame:
    """Objects read out of a reply with prose and fences around them."""
    n = table(spark, root, "nation").groupBy("n_regionkey").agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("j"))
    reply = F.when(F.col("n_regionkey") == 0, "no list here").when(F.col("n_regionkey") == 1, F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).otherwise(F.concat(F.lit("Here you are: "), "j", F.lit(" Done.")))
    return n.select("n_regionkey", F.explode(cl.json_objects(reply)).alias("o")).select("n_regionkey", F.get_json_object("o", "$.n_nationkey").cast("int").alias("id"), F.get_json_object("o", "$.n_name").alias("name"))


def declared_datatypes(spark: SparkSession, root: str) -> DataFrame:
    """What a declaration becomes when values of another datatype turn up: richer ones stay."""
    d = table(spark, root, "attribute_declarations").select("name", "datatype", F.explode(F.array(F.lit("integer"), F.lit("float"), F.lit("string"))).alias("seen"))
    return d.select("name", "seen", cl.kept_datatype(F.col("datatype"), F.col("seen")).alias("kept"))


QUERIES = {f.__name__: f for f in (typed_literals, clean_policies, placeholders, grounded_values, cell_faults, screened_rows, alias_pairs, scalar_cells, label_ladder, loose_matches, lookup_keys, envelope_ids, safe_iris, tolerant_json, declared_datatypes)}

_TITLE = "lower(title)"
_IN = lambda v: f"(NOT (lower(trim({v})) IN ('n/a', 'n.a.', 'null', 'unknown', 'unspecified', 'undefined', 'not available', 'not applicable', 'no data', 'no value', 'tbd', 'tba', 'test', 'placeholder')) AND ((length(trim({v})) >= 3 AND contains({_TITLE}, lower(trim({v})))) OR (length(regexp_replace({v}, '[^0-9]', '', 'g')) >= 3 AND contains(regexp_replace(title, '[^0-9]', '', 'g'), regexp_replace({v}, '[^0-9]', '', 'g'))) OR (length(regexp_replace(lower({v}), '[^a-z0-9]', '', 'g')) >= 3 AND contains(regexp_replace({_TITLE}, '[^a-z0-9]', '', 'g'), regexp_replace(lower({v}), '[^a-z0-9]', '', 'g')))))"
_ODD = "CASE fact_id % 7 WHEN 0 THEN 'Skip to content' WHEN 1 THEN '1998 intake' WHEN 2 THEN '14,000 learners annually' WHEN 3 THEN 'www.shop.example' WHEN 4 THEN '-- !' ELSE raw_value END"
ORACLE = {
    "typed_literals": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN CAST(c_acctbal AS VARCHAR) WHEN 1 THEN 'a^^b' || c_custkey ELSE '<entities/Customer/' || c_custkey || '>' END AS lexical, CASE WHEN c_custkey % 3 = 0 THEN 'float' ELSE 'string' END AS datatype, CASE c_custkey % 3 WHEN 0 THEN CAST(c_acctbal AS VARCHAR) WHEN 1 THEN 'a' ELSE 'entities/Customer/' || c_custkey END AS form FROM customer",
    "clean_policies": r"WITH c AS (SELECT record_id, nfc_normalize(specialty) AS s, lower(regexp_replace(trim(nfc_normalize(specialty)), '\s+', ' ', 'g')) AS v FROM healthcare_providers) SELECT record_id, CASE WHEN s IS NULL OR lower(trim(s)) IN ('', '-', '--', 'n/a', 'na', 'n.a.', 'nil', 'none', 'null', 'unknown', 'unspecified', 'not available', 'not applicable') THEN NULL ELSE v END AS value, CASE WHEN s IS NULL OR lower(trim(s)) IN ('', '-', '--', 'n/a', 'na', 'n.a.', 'nil', 'none', 'null', 'unknown', 'unspecified', 'not available', 'not applicable') THEN 'unknown_token' WHEN v <> s THEN 'canonicalized' ELSE 'unchanged' END AS reason FROM c",
    "placeholders": "SELECT DISTINCT phone, phone IN ('000-00-0000', '(123) 456-7890', '987654', 'xxxx', 'TBD', 'n/a ') OR lower(trim(phone)) IN ('n/a', 'n.a.', 'null', 'unknown', 'unspecified', 'undefined', 'not available', 'not applicable', 'no data', 'no value', 'tbd', 'tba') AS made_up FROM (SELECT phone FROM healthcare_providers WHERE phone IS NOT NULL UNION SELECT unnest(['000-00-0000', '(123) 456-7890', '987654', 'xxxx', 'TBD', '1000', '2024', '0000', 'n/a ', '12-34', 'xx', '111111x']))",
    "grounded_values": f"SELECT trial_row, coalesce({_IN('condition')}, false) AS condition, coalesce({_IN('phase')}, false) AS phase, coalesce((len(w) + 1) // 2 <= len(list_filter(w, lambda x: contains({_TITLE}, x))), false) AS name FROM (SELECT *, list_filter(string_split_regex('adult_' || lower(replace(condition, ' ', '_')) || '_count', '[_\\s-]+'), lambda x: length(x) >= 3 AND x NOT IN ('count', 'type', 'rate', 'level', 'the', 'for', 'and')) AS w FROM clinical_trials)",
    "cell_faults": f"""SELECT fact_id, CASE WHEN v IS NULL OR length(v) < 2 THEN 'too short' WHEN NOT regexp_matches(v, '[A-Za-z0-9]') THEN 'punctuation' WHEN starts_with(lower(v), 'skip to ') THEN 'page navigation' END AS name,
        CASE WHEN regexp_matches(v, '^[0-9]{{4}}\\b') THEN 'year' WHEN starts_with(v, 'www.') THEN 'url' WHEN contains(v, 'learners') THEN 'enrolment' END AS city, CASE WHEN v <> '' AND NOT regexp_matches(v, '(?i)\\b[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\\.[a-z0-9-]+)*\\.[a-z]{{2,24}}\\b') THEN 'no host' END AS website, CASE WHEN contains(v, 'learners') THEN 'enrolment' END AS address
        FROM (SELECT fact_id, trim(regexp_replace({_ODD}, '\\s+', ' ', 'g')) AS v FROM coffee_shops_facts WHERE attribute IN ('address', 'shop_id'))""",
    "screened_rows": "SELECT record_id, full_name, CASE WHEN record_id % 11 <> 0 AND NOT regexp_matches(city, '^[0-9]{4}') THEN city END AS city, CASE WHEN record_id % 11 = 0 THEN 'city' ELSE '' END AS scrubbed FROM healthcare_providers WHERE record_id % 50 <> 0 AND (full_name IS NULL OR trim(full_name) = '' OR length(trim(full_name)) >= 2)",
    "alias_pairs": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 < 2 THEN n_name END AS old, CASE n_nationkey % 3 WHEN 0 THEN 'N' || n_nationkey WHEN 1 THEN lower(n_name) END AS new FROM nation",
    "scalar_cells": "SELECT row_no, nullif(array_to_string(list_filter(parent_chain, lambda x: x IS NOT NULL AND trim(x) <> ''), ', '), '') AS list, trim(id) AS text, CAST(row_no AS VARCHAR) AS n, CAST(NULL AS VARCHAR) AS object, CASE WHEN row_no % 2 = 0 THEN 'true' ELSE 'false' END AS flag FROM coffee_shops",
    "label_ladder": r"""WITH m AS (SELECT model_id, concat_ws(' ', organization, CASE WHEN open_source THEN 'Model' END, display_name, 'X-' || coalesce(context_length, 0), '33') AS l FROM llm_models), w AS (SELECT model_id, l, string_split_regex(trim(l), '\s+') AS w FROM m),
        k AS (SELECT *, list_slice(w, 1, list_max(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN regexp_matches(w[i], '[0-9]') THEN 0 ELSE i END))) AS kept FROM w),
        c AS (SELECT model_id, [l, array_to_string(kept, ' '), CASE WHEN len(kept) >= 3 THEN array_to_string(list_slice(kept, 1, 2), ' ') END, w[1]] AS c FROM k), d AS (SELECT model_id, list_filter(range(1, 5), lambda i: c[i] IS NOT NULL AND list_position(c, c[i]) = i) AS pos, c FROM c)
        SELECT model_id, CAST(unnest(range(len(pos))) AS INTEGER) AS step, c[unnest(pos)] AS label FROM d""",
    "loose_matches": "WITH h AS (SELECT phone, min(hospital_affiliation) AS a, max(hospital_affiliation) AS b FROM healthcare_providers WHERE phone IS NOT NULL AND hospital_affiliation IS NOT NULL GROUP BY 1) SELECT a <> '' AND b <> '' AND (contains(lower(trim(a)), lower(trim(b))) OR contains(lower(trim(b)), lower(trim(a)))) AS same, count(*) AS n FROM h GROUP BY 1",
    "lookup_keys": r"SELECT 'v2:' || coalesce(trim(regexp_replace(lower(city), '\s+', ' ', 'g')), '') AS key, count(*) AS n FROM healthcare_providers GROUP BY 1",
    "envelope_ids": "SELECT p_partkey, substr(sha1(sha256('run|1') || '|' || sha256(p_brand) || '|' || sha256(least(sha256(p_type), sha256(p_name)) || ',' || greatest(sha256(p_type), sha256(p_name))) || '|' || sha256(CAST(p_partkey AS VARCHAR))), 1, 32) AS fact_id FROM part",
    "safe_iris": "SELECT term_id, NOT regexp_matches(term, '[<>\"{}|^`\\\\\\s]') AS raw, NOT regexp_matches(term, '[<>\"{}|^`\\\\]') AS joined FROM known_terms",
    "tolerant_json": "SELECT n_regionkey, n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey <> 0",
    "declared_datatypes": "WITH d AS (SELECT name, datatype, unnest(['integer', 'float', 'string']) AS seen FROM attribute_declarations) SELECT name, seen, CASE WHEN datatype = 'string' THEN seen ELSE datatype END AS kept FROM d",
}
