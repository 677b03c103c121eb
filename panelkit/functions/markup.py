"""Column expressions for HTML markup and URLs: character references, tag
tokens, attributes, reference resolution.  No user functions; regular
expressions avoid look-arounds and unbounded group repetition over single
characters, so long attributes do not overflow the matcher's stack."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

# Comments, and elements whose text is no page text.
NOISE = r"(?is)<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>|<!--.*?-->"
_QUOTED = r"""[^<>"']*(?:"[^"]*"[^<>"']*|'[^']*'[^<>"']*)*"""
# A tag (`>` may stand in a quoted value), a declaration, text, or a stray `<`.
TOKEN = rf"</?[A-Za-z]{_QUOTED}>|<[!?][^>]*>|[^<]+|<"
TAG_NAME = r"^</?([A-Za-z][^\s/>]*)"
# Elements that have no content and are never open.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
# The characters that code points 128 to 159 stand for in pages (windows-1252).
_C1 = {b: bytes([b]).decode("cp1252", "replace") for b in range(128, 160) if b not in (129, 141, 143, 144, 157)}
# Named references of HTML 4 and &apos;, from the standard library's table.
NAMED = {name: chr(point) for name, point in sorted(html.entities.name2codepoint.items())} | {"apos": "'"}
_URI = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def code_point(n: Column) -> Column:
    """The character of a code point given as bigint; U+FFFD where there is none."""
    ok = ((n > 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n < 0x110000))
    plain = F.decode(F.unhex(F.lpad(F.hex(F.when(ok, n).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    c1 = F.create_map(*[F.lit(x) for pair in _C1.items() for x in pair])
    return F.when(n.between(128, 159), F.coalesce(F.try_element_at(c1, n.cast("int")), plain)).otherwise(plain)


def _reference(piece: Column) -> Column:
    """The text after an `&`, its leading reference decoded."""
    number = F.regexp_extract(piece, "^#([0-9]+|[xX][0-9a-fA-F]+);?", 1)
    name = F.regexp_extract(piece, "^([A-Za-z][A-Za-z0-9]*);", 1)
    digits = F.when(number.rlike("^[xX]"), F.conv(F.substring(number, 2, 20), 16, 10)).otherwise(number)
    short = F.ltrim(digits, F.lit("0"))
    # more digits than the greatest code point has are no character
    point = F.when(F.length(short) > 8, F.lit(0).cast("bigint")).otherwise(
        F.when(short == "", F.lit(0).cast("bigint")).otherwise(short.cast("bigint")))
    known = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    return (F.when(number != "", F.concat(code_point(point), F.regexp_replace(piece, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", "")))
            .when(name != "", F.coalesce(F.concat(F.try_element_at(known, name), F.regexp_replace(piece, "^[A-Za-z0-9]+;", "")),
                                         F.concat(F.lit("&"), piece)))
            .otherwise(F.concat(F.lit("&"), piece)))


def decode_references(c: Column) -> Column:
    """Numeric and named character references decoded, each once (`&amp;lt;` stays
    `&lt;`).  A number may lack its semicolon, a name may not."""
    parts = F.split(c, "&")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), _reference)
    return F.when(F.contains(c, F.lit("&")), F.concat(parts[0], F.array_join(rest, ""))).otherwise(c)


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag token's attribute, references decoded; NULL without it."""
    at = rf"""(?i)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, at, k) for k in (1, 2, 3)])
    return F.when(tag.rlike(at), decode_references(value))


def has_class(tag: Column, wanted: str) -> Column:
    """Whether a tag token's class list holds `wanted`, or is it as a whole."""
    value = F.coalesce(attribute(tag, "class"), F.lit(""))
    return (value == wanted) | F.array_contains(F.split(value, r"\s+"), wanted)


def _without_dots(path: Column) -> Column:
    """`.` and `..` segments taken out, as RFC 3986, 5.2.4 says."""
    rooted = path.startswith("/")
    segments = F.split(F.when(rooted, F.substring(path, 2, 1 << 30)).otherwise(path), "/")
    none = F.array().cast("array<string>")
    walked = F.aggregate(segments, none, lambda acc, s: F.when(s == ".", acc).when(
        s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)))
    last = F.element_at(segments, -1)
    walked = F.when(last.isin(".", ".."), F.array_append(walked, F.lit(""))).otherwise(walked)
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(walked, "/"))


def resolve_url(base: Column, ref: Column) -> Column:
    """`ref` as an absolute URL against `base` (RFC 3986, 5.2).  White space around
    it is ignored; a NULL reference gives NULL, a NULL base leaves it relative."""
    ref, base = F.trim(ref), F.coalesce(base, F.lit(""))

    def part(u: Column, k: int) -> Column:
        return F.regexp_extract(u, _URI, k)

    def has(u: Column, pattern: str) -> Column:
        return u.rlike(pattern)

    scheme, path, rest = part(ref, 1), part(ref, 3), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?"
    base_authority = has(base, rest + "//")
    authority = has(ref, rest + "//")
    query, fragment = has(ref, r"^[^?#]*\?"), has(ref, "#")
    folder = F.regexp_replace(part(base, 3), "[^/]*$", "")
    merged = F.when(base_authority & (part(base, 3) == ""), F.concat(F.lit("/"), path)).otherwise(F.concat(folder, path))
    own = (scheme != "") | authority
    out_path = (F.when(own | path.startswith("/"), _without_dots(path))
                .when(path == "", part(base, 3)).otherwise(_without_dots(merged)))
    keep_query = ~own & (path == "") & ~query
    out_scheme = F.when(scheme != "", scheme).otherwise(part(base, 1))
    takes = F.when(own, authority).otherwise(base_authority)
    return F.concat(
        F.when(out_scheme != "", F.concat(out_scheme, F.lit(":"))).otherwise(""),
        F.when(takes, F.concat(F.lit("//"), F.when(own, part(ref, 2)).otherwise(part(base, 2)))).otherwise(""),
        out_path,
        F.when(query, F.concat(F.lit("?"), part(ref, 4)))
        .when(keep_query & has(base, r"^[^?#]*\?"), F.concat(F.lit("?"), part(base, 4))).otherwise(""),
        F.when(fragment, F.concat(F.lit("#"), part(ref, 5))).otherwise(""))
