"""Declarative rules as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def rule_column(rule: object) -> Column:
    """A membership rule tree (all, any, not; equals, in, contains, regex, nonempty) as one predicate; an empty rule is true, a malformed one false."""
    if rule in (None, {}):
        return F.lit(True)
    if not isinstance(rule, dict):
        return F.lit(False)
    for name, identity in (("all", True), ("any", False)):
        if name in rule:
            if not isinstance(rule[name], list):
                return F.lit(False)
            out = F.lit(identity)
            for r in rule[name]:
                out = (out & rule_column(r)) if identity else (out | rule_column(r))
            return out
    if "not" in rule:
        return ~rule_column(rule["not"])
    if "field" not in rule:
        return F.lit(False)
    text = F.coalesce(F.trim(F.col(rule["field"]).cast("string")), F.lit(""))
    low = F.lower(text)
    if "equals" in rule:
        return low == str(rule["equals"]).strip().lower()
    if "in" in rule and isinstance(rule["in"], (list, tuple)):
        return low.isin(*[str(x).strip().lower() for x in rule["in"]])
    if "contains" in rule:
        return low.contains(str(rule["contains"]).lower())
    if "regex" in rule:
        try:
            re.compile(rule["regex"])
        except re.error:
            return F.lit(False)
        return text.rlike(f"(?i){rule['regex']}")
    if "nonempty" in rule:
        return (text != "") if rule["nonempty"] else (text == "")
    return F.lit(False)
