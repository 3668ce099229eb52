"""Reading the seven declared datatypes from free text, all as JVM expressions.

All functions but `trimmed` take text without white space at its ends. `canonical(text, kind)` gives the canonical text of a value or null where it can't be read as `kind`:
integer plain digits, float as a double's text, boolean true/false, datetime `yyyy-MM-dd HH:mm:ss` (UTC),
geo `POINT(lon lat)` with digits kept, uri and string as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import computed

#: Marks of absence.
ABSENT = ("", "-", "--", "---", "?", "null", "none", "nil", "nan", "n/a", "na", "unknown", "tbd", "not available", "not applicable", "undefined")
#: Boolean words.
TRUE, FALSE = ("true", "1", "yes", "on", "t", "y"), ("false", "0", "no", "off", "f", "n")
#: Datetime patterns in the order in which they are tried; month first where only slashes and a trailing year.
DATETIME = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
    (r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,9})?$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$", "yyyy/MM/dd HH:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{2}:\d{2}:\d{2}$", "M/d/yyyy HH:mm:ss"),
    (r"^\p{L}{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\p{L}{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2} \p{L}{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} \p{L}{4,9} \d{4}$", "d MMMM yyyy"),
)
_NUMBER = r"[-+]?[0-9]+(?:\.[0-9]+)?"


def trimmed(v: Column) -> Column:
    """`v` without white space of any kind at its ends."""
    return F.regexp_replace(v, r"^[\s ]+|[\s ]+$", "")


def is_absent(v: Column) -> Column:
    return v.isNull() | F.lower(v).isin(*ABSENT)


def integer_text(v: Column) -> Column:
    t = v
    plain = F.when(t.rlike(r"^[-+]?[0-9]{1,3}(,[0-9]{3})+(\.0+)?$"), F.replace(t, F.lit(","), F.lit(""))).when(t.rlike(r"^[-+]?[0-9]+(\.0+)?$"), t)
    digits = F.regexp_extract(plain, r"^\+?(-?)0*([0-9]+)", 2)
    return F.when(plain.isNotNull(), F.concat(F.when(t.startswith("-") & (digits != "0"), "-").otherwise(""), digits))


def float_text(v: Column) -> Column:
    t = v
    plain = (
        F.when(t.rlike(r"^[-+]?[0-9]{1,3}(,[0-9]{3})+\.[0-9]+$"), F.replace(t, F.lit(","), F.lit("")))
        .when(t.rlike(r"^[-+]?[0-9]+,[0-9]+$"), F.replace(t, F.lit(","), F.lit(".")))
        .when(t.rlike(r"^[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?$"), t)
    )
    return plain.try_cast("double").cast("string")


def boolean_text(v: Column) -> Column:
    t = F.lower(v)
    return F.when(t.isin(*TRUE), "true").when(t.isin(*FALSE), "false")


def datetime_value(v: Column) -> Column:
    """A timestamp (session zone, which is UTC here); offsets are applied."""
    t = v
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s*(Z|[-+]\d{2}(:?\d{2})?)?$"), F.regexp_replace(t, r"([-+]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"))
    rest = [F.when(t.rlike(p), F.try_to_timestamp(t, F.lit(f))) for p, f in DATETIME if "[ T]" not in p]
    return F.coalesce(iso, *rest)


def geo_text(v: Column) -> Column:
    t = v
    wkt, pair = rf"(?i)^(?:SRID=\d+;)?POINT\s*\(\s*({_NUMBER})\s+({_NUMBER})\s*\)$", rf"^\(?({_NUMBER})\s*,\s*({_NUMBER})\)?$"
    lon = F.when(t.rlike(wkt), F.regexp_extract(t, wkt, 1)).when(t.rlike(pair), F.regexp_extract(t, pair, 2))
    lat = F.when(t.rlike(wkt), F.regexp_extract(t, wkt, 2)).when(t.rlike(pair), F.regexp_extract(t, pair, 1))
    ok = (F.abs(lon.try_cast("double")) <= 180) & (F.abs(lat.try_cast("double")) <= 90)
    return F.when(ok, F.concat(F.lit("POINT("), lon, F.lit(" "), lat, F.lit(")")))


def uri_text(v: Column) -> Column:
    t = v
    return F.when(t.rlike(r"(?i)^https?://\S+$"), t)


def canonical(v: Column, kind: Column) -> Column:
    """The canonical text of `v` read as `kind`; kinds other than the seven are read as string."""
    return (
        F.when(kind.isNull(), None)
        .when(kind == "integer", integer_text(v))
        .when(kind == "float", float_text(v))
        .when(kind == "boolean", boolean_text(v))
        .when(kind == "datetime", F.date_format(datetime_value(v), "yyyy-MM-dd HH:mm:ss"))
        .when(kind == "geo", geo_text(v))
        .when(kind == "uri", uri_text(v))
        .otherwise(v)
    )


#: Boolean words of declared datatypes.
DECLARED_TRUE, DECLARED_FALSE = ("true", "1", "yes", "on"), ("false", "0", "no", "off")


def coerced(v: Column, kind: Column) -> Column:
    """A raw value as text of its declared datatype, null where it can't be: integers are cut off at the point, floats as doubles, boolean words, http addresses; other kinds stay as they are."""
    t = trimmed(v)
    number = F.when(t.rlike(r"^[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?$"), t.try_cast("double"))
    word = F.lower(t)
    return (
        F.when(kind == "integer", F.when(F.abs(number) < 9e18, number.cast("long").cast("string")))
        .when(kind == "float", number.cast("string"))
        .when(kind == "boolean", F.when(word.isin(*DECLARED_TRUE), "true").when(word.isin(*DECLARED_FALSE), "false"))
        .when(kind == "datetime", F.date_format(datetime_value(t), "yyyy-MM-dd'T'HH:mm:ss"))
        .when(kind == "geo", geo_text(t))
        .when(kind == "uri", F.when(v.rlike("^https?://"), v))
        .otherwise(v)
    )


def conforms(v: Column, kind: Column) -> Column:
    """Whether a raw value is of its declared datatype as it stands."""
    t = trimmed(v)
    return (
        F.when(kind == "integer", t.rlike(r"^-?[0-9]+$"))
        .when(kind == "float", t.rlike(r"^-?[0-9]+(\.[0-9]+)?$"))
        .when(kind == "boolean", F.lower(t).isin("true", "false"))
        .when(kind == "datetime", datetime_value(t).isNotNull())
        .when(kind == "geo", geo_text(t).isNotNull() & t.rlike(r"(?i)^POINT"))
        .when(kind == "uri", v.rlike("^https?://"))
        .otherwise(F.lit(True))
    )


def cleaned(df: DataFrame, keep: list, value: Column, kind: Column) -> DataFrame:
    """`keep`, outcome (passed, transformed, dropped), value and reason of each raw value by its declared datatype. Blank values are dropped."""
    raw = computed(df, keep, _v=value, _k=kind)
    kept = [c for c in raw.columns if c not in ("_v", "_k")]
    read = computed(raw, [*kept, "_v", "_k"], _new=coerced(F.col("_v"), F.col("_k")), _fits=F.coalesce(conforms(F.col("_v"), F.col("_k")), F.lit(False)) & ~F.col("_k").isin("geo", "datetime"), _blank=F.col("_v").isNull() | (trimmed(F.col("_v")) == ""))
    outcome = F.when(F.col("_blank"), "dropped").when(F.col("_fits"), "passed").when(F.col("_new").isNull(), "dropped").when(F.col("_new") == F.col("_v"), "passed").otherwise("transformed")
    out = computed(read, [*kept, "_v", "_k", "_new", "_blank"], outcome=outcome)
    reason = F.when(F.col("_blank"), "no value").when(F.col("outcome") == "passed", "conforms").when(F.col("outcome") == "dropped", F.concat(F.lit("not "), "_k")).otherwise(F.concat(F.lit("coerced to "), "_k"))
    return out.select(*kept, "outcome", F.when(F.col("outcome") == "passed", F.col("_v")).when(F.col("outcome") == "transformed", F.col("_new")).alias("value"), reason.alias("reason"))
