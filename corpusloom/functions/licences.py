"""Licence rules as column functions. `bucket` is the canonical one; the other rules disagree with it in places, so
they are named policies, and `disagreement` shows where."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Buckets in order of precedence, each with what its texts contain: fixed values.
BUCKETS = {
    "cc_by_nc": ["by-nc", "noncommercial", "non-commercial"],
    "cc_by_nd": ["by-nd", "noderiv", "no derivatives"],
    "cc_by_sa": ["by-sa", "sharealike", "share alike"],
    "cc0_public_domain": ["zero", "cc0", "public domain", "publicdomain"],
    "cc_by": ["/by/", "attribution"],
}
ALL_BUCKETS = ["cc0_public_domain", "cc_by", "cc_by_sa", "cc_by_nc", "cc_by_nd", "other_unknown"]
DEPLOYABLE_BUCKETS = ["cc0_public_domain", "cc_by"]
#: Two spellings of an include and exclude rule: fixed values.
STRICT = (["attribution", "public domain", "cc0", "zero", "cc by"], ["noncommercial", "-nc", "sharealike", "-sa", "noderivative", "noderivs", "-nd"])
ON_DISK = (["attribution", "public domain", "cc0", "zero"], ["noncommercial", "no derivative", "noderiv", "share-alike", "sharealike", "-nc", "nc-", " nd"])
#: Exact names by policy: fixed values.
PERMISSIVE = ["CC0-1.0", "CC-BY-3.0", "CC-BY-4.0", "MIT", "public-domain"]
DEPLOYABLE = ["CC0-1.0", "CC0", "public-domain", "CC-BY-4.0", "CC-BY-3.0", "MIT", "Apache-2.0", "BSD-3-Clause"]
CLASS_PERMISSIVE = ["CC-BY-4.0", "CC-BY-3.0", "CC0-1.0", "CC0", "MIT", "Apache-2.0", "BSD-3-Clause", "public-domain"]


def _any(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(p) for p in parts))


def bucket(licence: Column) -> Column:
    text = F.replace(F.lower(F.trim(F.coalesce(licence, F.lit("")))), F.lit("_"), F.lit("-"))
    out = F.when(text == "", "other_unknown")
    for name, parts in BUCKETS.items():
        hit = _any(text, parts)
        out = out.when(hit | text.isin("cc by", "cc-by") if name == "cc_by" else hit, name)
    return out.otherwise("other_unknown")


def _policy(licence: Column, rule: tuple[list[str], list[str]]) -> Column:
    text = F.lower(F.trim(F.coalesce(licence, F.lit(""))))
    return (text != "") & ~_any(text, rule[1]) & _any(text, rule[0])


def strictly_deployable(licence: Column) -> Column:
    return _policy(licence, STRICT)


def deployable_on_disk(licence: Column) -> Column:
    return _policy(licence, ON_DISK)


def licence_class(name: Column) -> Column:
    """The class by a substring rule. NC anywhere, once blanks and hyphens are gone, counts as non-commercial, so
    `public licence` does too: that is this policy, reproduced as it is."""
    bare = F.regexp_replace(F.upper(name), "[- ]", "")
    named = name.isin(CLASS_PERMISSIVE)
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").when(bare.contains("NC"), "non-commercial").when(named | F.upper(name).startswith("CC-BY-4"), "permissive").otherwise("other")


def disagreement(licence: Column) -> Column:
    """Whether the rules differ about deployability."""
    canonical = bucket(licence).isin(DEPLOYABLE_BUCKETS)
    return (canonical != strictly_deployable(licence)) | (canonical != deployable_on_disk(licence))
