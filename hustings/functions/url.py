"""URL functions as expressions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from hustings.config import SECRET_KEYS, TRACKING_KEYS
from hustings.functions.text import strip

#: RFC 3986, appendix B: scheme, authority, path, query, fragment.
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(#.*)?$"


@dataclass(frozen=True)
class Parts:
    scheme: Column
    authority: Column
    path: Column
    query: Column
    fragment: Column


def parts(url: Column) -> Parts:
    return Parts(*[F.regexp_extract(url, _PARTS, i) for i in range(1, 6)])


def without_keys(query: Column, keys: Iterable[str]) -> Column:
    """The query's pairs, in order, without those of the given keys in any case."""
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.element_at(F.split(p, "="), 1)).isin(list(keys)))
    return F.array_join(kept, "&")


#: Characters that a form-encoded query holds as they are.
_PLAIN = r"^[A-Za-z0-9_.~&=+-]*$"


def form_encoded(query: Column) -> Column:
    """Pairs as a form encoder writes them: each key and value decoded, then encoded, a missing value as empty."""

    def pair(p: Column) -> Column:
        key, value = F.element_at(F.split(p, "=", 2), 1), F.coalesce(F.get(F.split(p, "=", 2), F.lit(1)), F.lit(""))
        again = lambda c: F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(c), c)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
        return F.concat(again(key), F.lit("="), again(value))

    full = F.array_join(F.transform(F.split(query, "&"), pair), "&")
    plain = query.rlike(_PLAIN) & ~query.rlike(r"(^|&)[^=&]*(&|$)|=[^&]*=")
    return F.when((query == "") | plain, query).otherwise(full)


def canonical_url(c: Column | str) -> Column:
    """URL to tell articles apart: https where no scheme stands, lower-case host without www., no slash at the
    path's end, no fragment or path parameters, no tracking keys; order and blank values of the query stay."""
    c = F.col(c) if isinstance(c, str) else c
    p = parts(strip(c))
    scheme = F.when(p.scheme == "", "https").otherwise(F.lower(p.scheme))
    host = F.regexp_replace(F.lower(p.authority), r"^www\.", "")
    bare = F.regexp_replace(F.regexp_replace(p.path, ";[^/]*$", ""), "/+$", "")
    path = F.when(bare == "", "/").otherwise(bare)
    query = form_encoded(without_keys(p.query, TRACKING_KEYS))
    return F.concat(scheme, F.lit("://"), host, F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def sanitized_url(c: Column | str) -> Column:
    """The URL without the keys that hold secrets; everything else as it is."""
    c = F.col(c) if isinstance(c, str) else c
    p = parts(c)
    query = form_encoded(without_keys(p.query, SECRET_KEYS))
    scheme = F.when(p.scheme == "", "").otherwise(F.concat(F.lower(p.scheme), F.lit(":")))
    authority = F.when(p.authority == "", "").otherwise(F.concat(F.lit("//"), p.authority))
    return F.concat(scheme, authority, p.path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)), F.when(p.fragment == "#", "").otherwise(p.fragment))


def domain(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(parts(strip(c)).authority), r"^www\.", "")
