"""Queries over the scalar functions, beside SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import names, text, typed_text
from ..model import fact_id, safe_id
from ..runtime import table

_PHONE = "regexp_replace(phone, '[^0-9]', '', 'g')"


#: Full forms of some first names; a table of them is a parameter of the function.
NICKNAMES = {"bob": "robert", "bill": "william", "liz": "elizabeth", "kate": "katherine", "mike": "michael", "vicky": "victoria"}


def slug(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "customer").select("c_custkey", safe_id(F.col("c_name")).alias("slug"))


def snake_pascal(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").select("p_partkey", names.snake_case(F.col("p_name")).alias("snake"), names.pascal_case(F.col("p_type")).alias("pascal"))


def name_normal_form(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "healthcare_providers").select("record_id", names.name_key(F.col("full_name"), NICKNAMES).alias("name_key"))


def email_normal_form(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "customer")
    mail = F.concat(F.lit(" User."), F.col("c_custkey").cast("string"), F.lit("+"), F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, "@Gmail.com").otherwise("@corp.example"))
    return c.select("c_custkey", names.email_key(mail).alias("email"))


def phone_normal_form(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "healthcare_providers").select("record_id", names.phone_key(F.col("phone")).alias("phone_e164"))


def address_normal_form(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "customer")
    address = F.concat(F.col("c_custkey").cast("string"), F.lit(" North Main Street, Suite "), F.col("c_nationkey").cast("string"))
    return c.select("c_custkey", names.address_key(address).alias("address"))


def birth_dates(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "M/d/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "d-M-yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-M-d"))
    return o.select("o_orderkey", names.birth_date(raw).alias("born"))


def sound_codes(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "known_terms").select("term_id", names.sound_code(F.regexp_replace(F.lower("term"), "[^a-z]", "")).alias("code"))


def coercion(spark: SparkSession, root: str) -> DataFrame:
    """The facts' raw values as their declared datatype, and as other ones."""
    f = table(spark, root, "coffee_shops_facts").select("fact_id", "raw_value", F.explode(F.array(F.col("datatype"), F.lit("integer"))).alias("datatype"))
    text = typed_text.coerced(F.col("raw_value"), F.col("datatype"))
    number = F.col("datatype").isin("integer", "float")
    return f.select("fact_id", "datatype", F.when(number, text.try_cast("double")).alias("as_number"), F.when(~number, text).alias("as_text"))


def clean_outcome(spark: SparkSession, root: str) -> DataFrame:
    """Each checked value as passed, transformed or dropped, by its declared datatype."""
    return typed_text.cleaned(table(spark, root, "coffee_shops_facts"), ["fact_id"], F.col("raw_value"), F.col("datatype")).select("fact_id", "outcome", "reason")


def list_split(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "part")
    packed = F.concat_ws(" || ", F.col("p_type"), F.col("p_brand"), F.col("p_type"))
    return p.select("p_partkey", F.array_join(text.split_list(packed, ["|", "||"]), "/").alias("parts"))


def relationship_cell(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "part")
    cell = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(", ", "p_brand", "p_type")).otherwise(F.concat_ws("|", "p_brand", "p_type"))
    return p.select("p_partkey", F.explode(text.target_labels(cell)).alias("label"))


def strip_emoji(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "part")
    return p.select("p_partkey", text.without_emoji(F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, " \U0001f600 ✨").otherwise(""))).alias("name"))


def snippets(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", text.snippet(F.col("text"), 120).alias("snippet"))


def word_counts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", F.size(text.tokens(F.coalesce("text", F.lit("")))).alias("n_tokens"))


def json_path(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def local_names(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "entity_spatiotemporal").select(text.local_name(F.col("entity_uri")).alias("name")).distinct()


def synthetic_keys(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "supplier")
    return s.select("s_suppkey", text.synthetic_key("Supplier", {"s_name": F.col("s_name"), "s_nationkey": F.col("s_nationkey")}).alias("key"))


def fact_ids(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "nation")
    return n.select("n_nationkey", fact_id(F.concat(F.lit("entities/Nation/"), F.col("n_nationkey").cast("string")), F.lit("rdfs:label"), F.col("n_name")).alias("fact_id"))


def csv_guard(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "customer")
    return c.select("c_custkey", text.csv_safe(F.when(F.col("c_acctbal") < 0, F.round("c_acctbal").cast("int").cast("string")).otherwise(F.col("c_name"))).alias("cell"))


def url_functions(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "attribute_declarations")
    url = F.concat(F.lit("HTTPS://user:pw@Graph.Invalid/"), F.col("name"), F.lit("/?token=abc&x=1"))
    return a.select("name", text.redact_url(url).alias("redacted"), text.normal_url(F.concat(F.lit("Graph.Invalid/"), F.col("name"), F.lit("/"))).alias("normal"))


def title_cased(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "clinical_trials").select("trial_row", text.title_case(F.col("status")).alias("status"))


def text_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of at most 2048 characters with their position."""
    d = table(spark, root, "documents").select("doc_id", text.chunks()("text").alias("c"))
    return d.select("doc_id", F.posexplode("c").alias("chunk_ix", "chunk")).select("doc_id", "chunk_ix", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("hash"))


QUERIES = {f.__name__: f for f in (slug, snake_pascal, name_normal_form, email_normal_form, phone_normal_form, address_normal_form, birth_dates, sound_codes, coercion, clean_outcome, list_split, relationship_cell, strip_emoji, snippets, word_counts, json_path, local_names, synthetic_keys, fact_ids, csv_guard, url_functions, title_cased, text_chunks)}

_TRIM = r"regexp_replace(raw_value, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g')"
_FLOAT = f"CASE WHEN regexp_matches({_TRIM}, '^[-+]?[0-9]{{1,3}}(,[0-9]{{3}})+\\.[0-9]+$') THEN replace({_TRIM}, ',', '') WHEN regexp_matches({_TRIM}, '^[-+]?[0-9]+,[0-9]+$') THEN replace({_TRIM}, ',', '.') WHEN regexp_matches({_TRIM}, '^[-+]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][-+]?[0-9]+)?$') THEN {_TRIM} END"
_WS = " || ".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
_LAST = lambda mark: f"CASE WHEN contains(w, {mark}) THEN length(w) - strpos(reverse(w), reverse({mark})) + 1 - length({mark}) ELSE -1 END"
ORACLE = {
    "text_chunks": f"""WITH RECURSIVE d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> ''), s AS (SELECT doc_id, -1 AS ix, 0 AS pos, CAST(NULL AS VARCHAR) AS piece FROM d UNION ALL
        SELECT doc_id, ix + 1, CAST(pos + e + length(substr(text, pos + e + 1)) - length(ltrim(substr(text, pos + e + 1), {_WS})) AS INTEGER), substr(text, pos + 1, e) FROM (
        SELECT *, CAST(CASE WHEN length(text) - pos <= 2048 THEN length(text) - pos WHEN k1 >= 1024 THEN k1 WHEN k2 >= 1024 THEN k2 + 1 WHEN k3 >= 1024 THEN k3 + 1 WHEN k4 >= 1024 THEN k4 + 1 WHEN k5 >= 1024 THEN k5 WHEN k6 >= 1024 THEN k6 ELSE 2048 END AS INTEGER) AS e FROM (
        SELECT *, {_LAST("chr(10) || chr(10)")} AS k1, {_LAST("'. '")} AS k2, {_LAST("'! '")} AS k3, {_LAST("'? '")} AS k4, {_LAST("chr(10)")} AS k5, {_LAST("' '")} AS k6 FROM (SELECT s.doc_id, ix, pos, text, substr(text, pos + 1, 2048) AS w FROM s JOIN d ON d.doc_id = s.doc_id WHERE pos < length(text)))))
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ix) - 1 AS INTEGER) AS chunk_ix, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS hash FROM (SELECT doc_id, ix, trim(piece, {_WS}) AS t FROM s WHERE ix >= 0) WHERE t <> ''""",
    "slug": "SELECT c_custkey, substr(regexp_replace(trim(c_name), '[^a-zA-Z0-9_-]', '_', 'g'), 1, 200) AS slug FROM customer",
    "snake_pascal": """SELECT p_partkey, lower(trim(regexp_replace(trim(p_name), '[^a-zA-Z0-9]+', '_', 'g'), '_')) AS snake,
        list_aggregate(list_transform(string_split(lower(trim(regexp_replace(trim(p_type), '[^a-zA-Z0-9]+', '_', 'g'), '_')), '_'), lambda p: upper(p[1]) || p[2:]), 'string_agg', '') AS pascal FROM part""",
    "name_normal_form": r"""SELECT record_id, nullif(array_to_string(list_sort(list_transform(list_filter(string_split(trim(regexp_replace(regexp_replace(strip_accents(replace(lower(full_name), 'ø', '#')), '[^a-z\s''\-]', ' ', 'g'), '\s+', ' ', 'g')), ' '),
        lambda w: w <> '' AND w NOT IN ('mr','mrs','ms','miss','dr','sir','dame','jr','sr','ii','iii','iv','phd','md')), lambda w, i: CASE WHEN i = 1 THEN coalesce(MAP {""" + ", ".join(f"'{k}': '{v}'" for k, v in NICKNAMES.items()) + r"""}[w], w) ELSE w END)), ' '), '') AS name_key FROM healthcare_providers""",
    "email_normal_form": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'user' || c_custkey || '@gmail.com' ELSE 'user.' || c_custkey || '@corp.example' END AS email FROM customer",
    "phone_normal_form": f"SELECT record_id, CASE WHEN {_PHONE} = '' THEN NULL WHEN NOT starts_with(ltrim(phone), '+') AND length({_PHONE}) = 10 THEN '+1' || {_PHONE} ELSE '+' || {_PHONE} END AS phone_e164 FROM healthcare_providers",
    "address_normal_form": "SELECT c_custkey, c_custkey || ' n main st suite ' || c_nationkey AS address FROM customer".replace("suite ' || c_nationkey", "ste ' || c_nationkey"),
    "birth_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS born FROM orders",
    "sound_codes": """WITH t AS (SELECT term_id, regexp_replace(lower(term), '[^a-z]', '', 'g') AS w FROM known_terms),
        d AS (SELECT term_id, w, regexp_replace(translate(substr(w, 2), 'bfpvcgjkqsxzdtlmnr', '111122222222334556'), '[^1-6]', '', 'g') AS c FROM t)
        SELECT term_id, substr(upper(w[1]) || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g') || '000', 1, 4) AS code FROM d""",
    "coercion": f"""WITH f AS (SELECT fact_id, raw_value, unnest([datatype, 'integer']) AS datatype FROM coffee_shops_facts), x AS (SELECT *, CASE WHEN regexp_matches({_TRIM}, '^[-+]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][-+]?[0-9]+)?$') THEN TRY_CAST({_TRIM} AS DOUBLE) END AS n FROM f)
        SELECT fact_id, datatype, CASE datatype WHEN 'integer' THEN trunc(n) WHEN 'float' THEN n END AS as_number, CASE datatype WHEN 'boolean' THEN CASE WHEN lower({_TRIM}) IN ('true', '1', 'yes', 'on') THEN 'true' WHEN lower({_TRIM}) IN ('false', '0', 'no', 'off') THEN 'false' END WHEN 'string' THEN raw_value END AS as_text FROM x""",
    "clean_outcome": f"""WITH x AS (SELECT fact_id, datatype, raw_value, {_TRIM} AS t FROM coffee_shops_facts), y AS (SELECT *, CASE datatype WHEN 'float' THEN regexp_matches(t, '^-?[0-9]+(\\.[0-9]+)?$') WHEN 'boolean' THEN lower(t) IN ('true', 'false') ELSE true END AS fits,
        CASE datatype WHEN 'float' THEN regexp_matches(t, '^[-+]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][-+]?[0-9]+)?$') WHEN 'boolean' THEN lower(t) IN ('true', '1', 'yes', 'on', 'false', '0', 'no', 'off') ELSE true END AS can FROM x)
        SELECT fact_id, CASE WHEN raw_value IS NULL OR t = '' THEN 'dropped' WHEN fits THEN 'passed' WHEN can THEN 'transformed' ELSE 'dropped' END AS outcome, CASE WHEN raw_value IS NULL OR t = '' THEN 'no value' WHEN fits THEN 'conforms' WHEN can THEN 'coerced to ' || datatype ELSE 'not ' || datatype END AS reason FROM y""",
    "list_split": "SELECT p_partkey, CASE WHEN p_type = p_brand THEN p_type ELSE p_type || '/' || p_brand END AS parts FROM part",
    "relationship_cell": "SELECT p_partkey, unnest([p_brand, p_type]) AS label FROM part",
    "strip_emoji": r"SELECT p_partkey, trim(regexp_replace(p_name, '\s+', ' ', 'g')) AS name FROM part",
    "word_counts": "SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS n_tokens FROM documents",
    "json_path": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "local_names": "SELECT DISTINCT replace(regexp_replace(entity_uri, '^.*[/#]', ''), '_', ' ') AS name FROM entity_spatiotemporal",
    "synthetic_keys": "SELECT s_suppkey, substr(sha1('Supplier|s_name=' || trim(s_name) || '|s_nationkey=' || s_nationkey), 1, 16) AS key FROM supplier",
    "fact_ids": "SELECT n_nationkey, sha1('entities/Nation/' || n_nationkey || '|rdfs:label|' || n_name) AS fact_id FROM nation",
    "csv_guard": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN CASE WHEN round(c_acctbal) < 0 THEN '''' ELSE '' END || CAST(CAST(round(c_acctbal) AS INTEGER) AS VARCHAR) ELSE c_name END AS cell FROM customer",
    "url_functions": "SELECT name, 'HTTPS://Graph.Invalid/' || name || '/?token=REDACTED&x=1' AS redacted, 'https://graph.invalid/' || name AS normal FROM attribute_declarations",
    "title_cased": "SELECT trial_row, array_to_string(list_transform(string_split(lower(trim(regexp_replace(status, '\\s+', ' ', 'g'))), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS status FROM clinical_trials",
    "snippets": r"SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE rtrim(CASE WHEN regexp_extract(substr(text, 1, 120), '(?s)^(.+) [^ ]*$', 1) <> '' THEN regexp_extract(substr(text, 1, 120), '(?s)^(.+) [^ ]*$', 1) ELSE substr(text, 1, 120) END) || '…' END AS snippet FROM documents",
}
