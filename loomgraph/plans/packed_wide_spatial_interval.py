"""Queries over the general data-processing operators: packed fields, wide tables, spatial joins, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geometry import with_point
from ..operators.intervals import gaps, periods, with_range
from ..operators.packed import CANDIDATES, WEAK, delimiter_profile, split_packed
from ..operators.spatial import radius_join, regions_containing
from ..operators.wide import cast_failures, cells_of, widen
from ..runtime import bounded_rows, table

LIST_ATTRIBUTES = ("categories", "amenities", "roasts")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    terms = table(spark, root, "known_terms")
    facts = table(spark, root, "coffee_shops_facts").filter(F.col("attribute").isin(*LIST_ATTRIBUTES))
    raw = split_packed(facts, "fact_id", "raw_value", F.col("attribute"), terms.filter(F.col("field").isin(*LIST_ATTRIBUTES)).select("term"))
    special = split_packed(table(spark, root, "healthcare_providers"), "record_id", "specialty", F.col("feed"), terms.filter("field = 'specialty'").select("term"))
    row = lambda d, field, key: d.select(F.lit(field).alias("field"), F.col(key).alias("row_id"), "pos", "value")
    return row(raw, "raw_value", "fact_id").unionByName(row(special, "specialty", "record_id"))


def p1_delimiters(spark: SparkSession, root: str) -> DataFrame:
    """How each candidate delimiter scores in each source."""
    terms = table(spark, root, "known_terms")
    known = lambda where: frozenset(r[0] for r in bounded_rows(terms.filter(where).select("term"), 1_000_000, "the table of known terms"))
    facts = table(spark, root, "coffee_shops_facts").filter(F.col("attribute").isin(*LIST_ATTRIBUTES))
    a = delimiter_profile(facts, F.concat(F.lit("raw_value/"), "attribute"), F.col("raw_value"), known(F.col("field").isin(*LIST_ATTRIBUTES)))
    b = delimiter_profile(table(spark, root, "healthcare_providers"), F.concat(F.lit("specialty/"), "feed"), F.col("specialty"), known("field = 'specialty'"))
    return a.unionByName(b).select("source", "delimiter", "n_rows", F.round("score", 6).alias("score"), (F.col("score") < WEAK).alias("weak"))


def _declarations(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "attribute_declarations").filter("type_name = 'CoffeeShop'")


def p2_wide(spark: SparkSession, root: str) -> DataFrame:
    return widen(table(spark, root, "coffee_shops"), "id", "attributes", "extracted_at", _declarations(spark, root)).drop("cast_failures")


def _declared(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    return [(r[0], r[1]) for r in bounded_rows(_declarations(spark, root).select("name", "datatype").distinct(), 2_000, "the table of declarations")]


def p2_failures(spark: SparkSession, root: str) -> DataFrame:
    """Every value that can't be read as its declared type, with its time."""
    return cast_failures(table(spark, root, "coffee_shops"), "id", "attributes", "extracted_at", _declared(spark, root))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return cells_of(widen(table(spark, root, "coffee_shops"), "id", "attributes", "extracted_at", _declarations(spark, root)), "id", _declared(spark, root))


def _points(spark: SparkSession, root: str) -> DataFrame:
    return with_point(table(spark, root, "entity_spatiotemporal"), [F.col("fact_id").alias("point_id")], F.col("geom"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    points = _points(spark, root)
    anchors = table(spark, root, "spatial_anchors").select(F.col("anchor_id").alias("centre_id"), "lon", "lat", "radius_m")
    near = radius_join(points, anchors).select(F.lit("anchor").alias("place_kind"), F.col("centre_id").alias("place_id"), F.col("point_id").alias("fact_id"))
    inside = regions_containing(points, table(spark, root, "spatial_regions"))
    return near.unionByName(inside.select(F.lit("region").alias("place_kind"), F.col("region_id").alias("place_id"), F.col("point_id").alias("fact_id")))


def _ranges(spark: SparkSession, root: str) -> tuple[DataFrame, list]:
    keys = ["tenant_id", "kg_name", "entity_uri"]
    return with_range(table(spark, root, "entity_spatiotemporal"), keys, F.col("valid_time")), [F.col(k) for k in keys]


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    facts, keys = _ranges(spark, root)
    out = gaps(facts, keys, F.col("lo"), F.col("hi"))
    second = lambda c: F.floor(F.col(c) / 1_000_000).cast("long")
    return out.select(F.col("k0").alias("tenant_id"), F.col("k1").alias("kg_name"), F.col("k2").alias("entity_uri"), second("gap_lo").alias("gap_from"), second("gap_hi").alias("gap_to"))


def p6_periods(spark: SparkSession, root: str) -> DataFrame:
    facts, keys = _ranges(spark, root)
    out = periods(facts, keys, F.col("lo"), F.col("hi"))
    second = lambda c: F.floor(F.col(c) / 1_000_000).cast("long")
    return out.select(F.col("k0").alias("tenant_id"), F.col("k1").alias("kg_name"), F.col("k2").alias("entity_uri"), second("lo").alias("period_from"), second("hi").alias("period_to"))


QUERIES = {f.__name__: f for f in (p1_found, p1_delimiters, p2_found, p2_wide, p2_failures, p4_found, p6_found, p6_periods)}

_RANGES = r"""
raw AS (
  SELECT tenant_id, kg_name, entity_uri,
    regexp_extract(valid_time, '^\s*[\[(]\s*"?\s*([^",\])]*?)\s*"?\s*,\s*"?\s*([^",\])]*?)\s*"?\s*[\])]\s*$', 1) AS a,
    regexp_extract(valid_time, '^\s*[\[(]\s*"?\s*([^",\])]*?)\s*"?\s*,\s*"?\s*([^",\])]*?)\s*"?\s*[\])]\s*$', 2) AS b
  FROM entity_spatiotemporal
  WHERE regexp_matches(valid_time, '^\s*[\[(]\s*"?\s*([^",\])]*?)\s*"?\s*,\s*"?\s*([^",\])]*?)\s*"?\s*[\])]\s*$')),
bounds AS (
  SELECT tenant_id, kg_name, entity_uri,
    CASE WHEN a = '' OR lower(a) = '-infinity' THEN -4611686018427387904 ELSE epoch_us(TRY_CAST(a AS TIMESTAMPTZ)) END AS lo,
    CASE WHEN b = '' OR lower(b) IN ('infinity', '+infinity') THEN 4611686018427387904 ELSE epoch_us(TRY_CAST(b AS TIMESTAMPTZ)) END AS hi
  FROM raw),
spans AS (
  SELECT DISTINCT * FROM bounds
  WHERE lo <= hi AND NOT (lo = -4611686018427387904 AND hi = 4611686018427387904)),
marked AS (
  SELECT *, max(hi) OVER (PARTITION BY tenant_id, kg_name, entity_uri ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM spans)
"""
_CELLS = r"""
raw AS (SELECT id, extracted_at AS ts, i, attributes[i] AS a FROM (SELECT id, extracted_at, attributes, unnest(range(1, len(attributes) + 1)) AS i FROM coffee_shops WHERE id IS NOT NULL)),
named AS (
  SELECT id, ts, i, d.name, d.datatype AS t, a.value AS v, regexp_replace(a.value, '^\s+|\s+$', '', 'g') AS w
  FROM raw JOIN attribute_declarations d ON regexp_replace(lower(a.name), '[^a-z0-9]', '', 'g') = replace(d.name, '_', '') WHERE d.type_name = 'CoffeeShop'),
present AS (SELECT * FROM named WHERE w IS NOT NULL AND lower(w) NOT IN ('', '-', '--', '---', '?', 'null', 'none', 'nil', 'nan', 'n/a', 'na', 'unknown', 'tbd', 'not available', 'not applicable', 'undefined')),
read AS (SELECT *, CASE t
  WHEN 'integer' THEN CASE WHEN regexp_matches(w, '^[-+]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\.0+)?$') THEN regexp_replace(replace(w, ',', ''), '^\+?(-?)0*([0-9]+)(\.0+)?$', '\1\2') END
  WHEN 'float' THEN printf('%.2f', CASE WHEN regexp_matches(w, '^[-+]?[0-9]+,[0-9]+$') THEN TRY_CAST(replace(w, ',', '.') AS DOUBLE) WHEN regexp_matches(w, '^[-+]?[0-9]+(\.[0-9]*)?$') THEN TRY_CAST(w AS DOUBLE) END)
  WHEN 'boolean' THEN CASE WHEN lower(w) IN ('true', '1', 'yes', 'on', 't', 'y') THEN 'true' WHEN lower(w) IN ('false', '0', 'no', 'off', 'f', 'n') THEN 'false' END
  WHEN 'datetime' THEN strftime(try_strptime(w, ['%Y-%m-%d', '%Y/%m/%d', '%m/%d/%Y', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M:%SZ', '%B %d, %Y', '%b %d, %Y', '%d %b %Y', '%d %B %Y']), '%Y-%m-%d %H:%M:%S')
  WHEN 'geo' THEN CASE WHEN regexp_matches(w, '^POINT ?\(') THEN regexp_replace(w, '^POINT ?\(([^ ]+) ([^)]+)\)$', 'POINT(\1 \2)') WHEN regexp_matches(w, '^[-+0-9.]+,[-+0-9.]+$') THEN regexp_replace(w, '^([^,]+),(.+)$', 'POINT(\2 \1)') END
  WHEN 'uri' THEN CASE WHEN regexp_matches(w, '^https?://\S+$') THEN w END
  ELSE w END AS value FROM present)"""
_NUM = r"[-+]?[0-9]+(?:\.[0-9]*)?(?:[eE][-+]?[0-9]+)?"
_HEX = lambda at: f"(CASE WHEN substr(g, 1, 2) = '01' THEN array_to_string(list_transform(range(15, 0, -2), lambda k: substr(substr(g, off + {at}, 16), k, 2)), '') ELSE substr(g, off + {at}, 16) END)"
_IEEE = lambda h: f"CASE WHEN (('0x' || substr({h}, 1, 3))::BIGINT % 2048) = 0 THEN 0.0 ELSE (CASE WHEN ('0x' || substr({h}, 1, 3))::BIGINT >= 2048 THEN -1 ELSE 1 END) * (1.0 + ('0x' || substr({h}, 4, 13))::BIGINT / 4503599627370496.0) * pow(2.0, ('0x' || substr({h}, 1, 3))::BIGINT % 2048 - 1023) END"
#: Points of the facts in each notation, by SQL alone.
POINTS_SQL = rf"""
texts AS (SELECT fact_id, entity_uri, valid_time, geom AS g FROM entity_spatiotemporal WHERE geom IS NOT NULL),
wkb AS (SELECT fact_id, entity_uri, valid_time, g, CASE WHEN substr(g, CASE WHEN substr(g, 1, 2) = '01' THEN 9 ELSE 3 END, 2) IN ('20', 'A0', 'E0', '60', 'a0', 'e0') THEN 19 ELSE 11 END AS off FROM texts WHERE regexp_matches(g, '^(?:01010000[0-9A-Fa-f]{{2}}(?:[0-9A-Fa-f]{{8}})?|00[0-9A-Fa-f]{{2}}000001(?:[0-9A-Fa-f]{{8}})?)[0-9A-Fa-f]{{32,64}}$')),
hexes AS (SELECT fact_id, entity_uri, valid_time, {_HEX(0)} AS hx, {_HEX(16)} AS hy FROM wkb),
read AS (
  SELECT fact_id, entity_uri, valid_time, {_IEEE('hx')} AS lon, {_IEEE('hy')} AS lat FROM hexes
  UNION ALL SELECT fact_id, entity_uri, valid_time, TRY_CAST(regexp_extract(g, '(?i)POINT\s*(?:ZM|Z|M)?\s*\(\s*({_NUM})\s+({_NUM})', 1) AS DOUBLE), TRY_CAST(regexp_extract(g, '(?i)POINT\s*(?:ZM|Z|M)?\s*\(\s*({_NUM})\s+({_NUM})', 2) AS DOUBLE) FROM texts WHERE regexp_matches(g, '(?i)^\s*(?:SRID=\d+;)?\s*POINT\s*(?:ZM|Z|M)?\s*\(\s*{_NUM}\s+{_NUM}(?:\s+{_NUM}){{0,2}}\s*\)\s*$')
  UNION ALL SELECT fact_id, entity_uri, valid_time, TRY_CAST(regexp_extract(g, '"coordinates"\s*:\s*\[\s*({_NUM})\s*,\s*({_NUM})', 1) AS DOUBLE), TRY_CAST(regexp_extract(g, '"coordinates"\s*:\s*\[\s*({_NUM})\s*,\s*({_NUM})', 2) AS DOUBLE) FROM texts WHERE contains(g, '{{') AND regexp_matches(g, '"type"\s*:\s*"Point"')
  UNION ALL SELECT fact_id, entity_uri, valid_time, TRY_CAST(regexp_extract(g, '^\s*\(?\s*({_NUM})\s*,\s*({_NUM})\s*\)?\s*$', 2) AS DOUBLE), TRY_CAST(regexp_extract(g, '^\s*\(?\s*({_NUM})\s*,\s*({_NUM})\s*\)?\s*$', 1) AS DOUBLE) FROM texts WHERE regexp_matches(g, '^\s*\(?\s*{_NUM}\s*,\s*{_NUM}\s*\)?\s*$')),
points AS (SELECT * FROM read WHERE abs(lon) <= 180 AND abs(lat) <= 90)"""
_UNIT = "cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z"
_KNOWN = lambda field: f"(SELECT list(term) FROM known_terms WHERE field {field})"
_SQL_PIECES = "list_transform(list_filter(string_split_regex(v, p), lambda x: trim(x) <> ''), lambda x: CASE WHEN length(trim(x)) > 1 AND starts_with(trim(x), '\"') AND suffix(trim(x), '\"') THEN trim(regexp_replace(replace(substr(trim(x), 2, length(trim(x)) - 2), '\"\"', '\"'), '\\\\(.)', '\\1', 'g')) WHEN length(trim(x)) > 1 AND starts_with(trim(x), chr(39)) AND suffix(trim(x), chr(39)) THEN trim(substr(trim(x), 2, length(trim(x)) - 2)) ELSE trim(x) END)"
_CANDIDATES_SQL = " UNION ALL ".join(f"SELECT '{n}' AS delimiter, '{p}' AS p" for n, p in CANDIDATES)
#: The declared attributes of shops by datatype, for the SQL of the wide table.
_DECLARED = {
    "DOUBLE": "rating wifi_speed_mbps espresso_price drip_price floor_area_m2 delivery_radius_km water_hardness",
    "DECIMAL(38,0)": "seat_count review_count inspection_score bike_racks annual_beans_kg parking_spots queue_minutes",
    "BOOLEAN": "outdoor_seating accepts_cards pet_friendly drive_through has_roaster loyalty_program live_music",
    "TIMESTAMP": "opened_on last_inspected closed_on renewed_on",
    "VARCHAR": "price_level address name phone website location owner_name menu_url neighborhood branch_of noise_level license_no mascot",
}
_WIDE = ", ".join(f"max(CASE WHEN name = '{n}' THEN TRY_CAST(value AS {t}) END) AS \"{n}\"" for t, names in _DECLARED.items() for n in names.split())
ORACLE = {
    "p2_wide": f"WITH {_CELLS}, best AS (SELECT id, name, value FROM read WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, name ORDER BY ts DESC, i DESC) = 1) SELECT k.id, {_WIDE} FROM (SELECT DISTINCT id FROM coffee_shops WHERE id IS NOT NULL) k LEFT JOIN (SELECT id AS bid, name, value FROM best) ON bid = k.id GROUP BY k.id",
    "p1_delimiters": f"""WITH c AS ({_CANDIDATES_SQL}), r AS (SELECT 'raw_value/' || attribute AS source, regexp_replace(raw_value, '[\\s]', ' ', 'g') AS t, raw_value AS v, {_KNOWN("IN ('categories', 'amenities', 'roasts')")} AS terms FROM coffee_shops_facts WHERE attribute IN ('categories', 'amenities', 'roasts') AND trim(raw_value) <> '' UNION ALL SELECT 'specialty/' || feed, '', specialty, {_KNOWN("= 'specialty'")} FROM healthcare_providers WHERE trim(specialty) <> ''),
        x AS (SELECT source, delimiter, {_SQL_PIECES} AS pieces, terms FROM r JOIN c ON regexp_matches(v, p)), y AS (SELECT source, delimiter, len(pieces) AS n, len(list_filter(pieces, lambda z: list_contains(terms, z))) AS k FROM x),
        z AS (SELECT source, delimiter, count(*) AS n_rows, sum(n) AS pieces, sum(n * n) AS squares, sum(k) AS regular FROM y GROUP BY 1, 2), w AS (SELECT source, delimiter, n_rows, CASE WHEN pieces > 0 THEN 1.0 / (1.0 + sqrt(greatest(0.0, squares / n_rows - (pieces / n_rows) * (pieces / n_rows))) / (pieces / n_rows)) * (regular / pieces) ELSE 0.0 END AS s FROM z)
        SELECT source, delimiter, n_rows, round(s, 6) AS score, s < {WEAK} AS weak FROM w""",
    "p4_found": rf"""WITH {POINTS_SQL}, p AS (SELECT fact_id, lon, lat, {_UNIT} FROM points), a AS (SELECT anchor_id, radius_m, {_UNIT} FROM spatial_anchors WHERE abs(lon) <= 180 AND abs(lat) <= 90 AND radius_m >= 0),
        rings AS (SELECT region_id, unnest(regexp_extract_all(boundary, '\(([^()]+)\)', 1)) AS ring FROM spatial_regions), nodes AS (SELECT region_id, string_split(ring, ',') AS n FROM rings),
        edges AS (SELECT region_id, CAST(string_split(trim(n[i]), ' ')[1] AS DOUBLE) AS x1, CAST(string_split(trim(n[i]), ' ')[-1] AS DOUBLE) AS y1, CAST(string_split(trim(n[1 + i % len(n)]), ' ')[1] AS DOUBLE) AS x2, CAST(string_split(trim(n[1 + i % len(n)]), ' ')[-1] AS DOUBLE) AS y2 FROM (SELECT region_id, n, unnest(range(1, len(n) + 1)) AS i FROM nodes))
        SELECT 'anchor' AS place_kind, anchor_id AS place_id, fact_id FROM p JOIN a ON 2 * 6371008.8 * asin(least(1.0, sqrt((p.x - a.x) ** 2 + (p.y - a.y) ** 2 + (p.z - a.z) ** 2) / 2)) <= radius_m
        UNION ALL SELECT 'region', region_id, fact_id FROM points JOIN edges ON (y1 > lat) <> (y2 > lat) AND lon > (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY region_id, fact_id HAVING count(*) % 2 = 1""",
    "p2_found": f"WITH {_CELLS} SELECT id, name, value FROM read WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, name ORDER BY ts DESC, i DESC) = 1",
    "p2_failures": f"WITH {_CELLS} SELECT id, name, v AS value, ts AS extracted_at FROM read WHERE value IS NULL",
    "p6_found": f"WITH {_RANGES} SELECT tenant_id, kg_name, entity_uri, before // 1000000 AS gap_from, lo // 1000000 AS gap_to FROM marked WHERE lo > before",
    "p6_periods": f"""WITH {_RANGES}, numbered AS (
        SELECT *, sum(CASE WHEN before IS NULL OR lo > before THEN 1 ELSE 0 END) OVER (PARTITION BY tenant_id, kg_name, entity_uri ORDER BY lo, hi) AS n FROM marked)
        SELECT tenant_id, kg_name, entity_uri,
          CASE WHEN min(lo) > -4611686018427387904 THEN min(lo) // 1000000 END AS period_from,
          CASE WHEN max(hi) < 4611686018427387904 THEN max(hi) // 1000000 END AS period_to
        FROM numbered GROUP BY tenant_id, kg_name, entity_uri, n""",
}
