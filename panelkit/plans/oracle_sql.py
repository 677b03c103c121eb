"""DuckDB SQL for every catalog query (the correctness oracle).

The adapters are the same SELECTs as `panelkit.sources.fixtures`, written in
DuckDB's dialect; each query composes them as CTEs.
"""

from __future__ import annotations

EVENT_BARS = """SELECT CAST(ts AS DATE) AS date, event_type AS ticker,
  arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, ts) AS close, arg_max(value, ts) AS adj_close,
  CAST(count(*) AS DOUBLE) AS volume
FROM events GROUP BY 1, 2"""

BRAND_LINES = """SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice,
  l_returnflag, l_shipdate, p_brand,
  l_orderkey * 1000000.0 + l_linenumber * 100000.0 + l_extendedprice / 10.0 AS k
FROM lineitem JOIN part ON l_partkey = p_partkey"""

BRAND_BARS = f"""SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS ticker,
  arg_min(l_extendedprice, k) AS open, max(l_extendedprice) AS high,
  min(l_extendedprice) AS low, arg_max(l_extendedprice, k) AS close,
  arg_max(l_extendedprice, k) AS adj_close, sum(l_quantity) AS volume
FROM ({BRAND_LINES}) GROUP BY 1, 2"""


def dated_news(base: str = "1995-01-02", days: int = 2498, copies: int = 1) -> str:
    return f"""SELECT DATE '{base}' + CAST((doc_id * 37 + copy * 419) % {days} AS INTEGER) AS date,
  concat('doc://', CAST(doc_id AS VARCHAR), '/', CAST(copy AS VARCHAR)) AS url, source,
  CASE WHEN doc_id % 97 = 5 THEN NULL ELSE split_part(text, chr(10), 1) END AS title,
  CASE WHEN doc_id % 89 = 7 THEN NULL ELSE text END AS article,
  doc_id * {copies} + copy AS ord
FROM documents, range({copies}) c(copy)"""


DATED_NEWS = dated_news()
DAILY_NEWS = dated_news(copies=6)
EVENT_NEWS = dated_news("2024-01-01", 30)

TRADES = f"""SELECT l_suppkey % 5 AS account, CAST(l_shipdate AS DATE) AS date, p_brand AS symbol,
  CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side,
  CAST(sum(l_quantity) AS BIGINT) AS shares
FROM ({BRAND_LINES}) GROUP BY 1, 2, 3, 4"""

KEYWORDS = ("tion", "the", "que")


def kw_count(text: str = "article") -> str:
    parts = [f"len(regexp_extract_all(coalesce({text}, ''), '{k}'))" for k in KEYWORDS]
    return "CAST(" + " + ".join(parts) + " AS INTEGER)"


def with_(**ctes) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n"


def frames_values(frames) -> str:
    rows = ", ".join(f"('{s}', DATE '{a}', DATE '{b}')" for s, a, b in frames)
    return f"SELECT * FROM (VALUES {rows}) t(split, fstart, fend)"


BRAND_FRAMES = (("train", "1995-01-01", "1999-12-31"), ("val", "2000-01-01", "2000-12-31"),
                ("test", "2001-01-01", "2001-12-31"))


def labels_sql(labels) -> str:
    return "[" + ", ".join(f"'{x}'" for x in labels) + "]"


def py_repr_sql(t: str) -> str:
    """Python repr() of a string, in DuckDB (backslashes are literal there)."""
    esc = (f"replace(replace(replace(replace({t}, '\\', '\\\\'), chr(10), '\\n'), "
           f"chr(13), '\\r'), chr(9), '\\t')")
    return (f"CASE WHEN contains({t}, '''') AND NOT contains({t}, '\"') THEN '\"' || {esc} || '\"' "
            f"ELSE '''' || replace({esc}, '''', '\\''') || '''' END")


def classed_pages() -> str:
    """The pages as a site with classed, nested blocks would serve them."""
    day = "DATE '2023-01-01' + CAST(page_id * 37 % 365 AS INTEGER)"
    clock = "strftime(TIMESTAMP '1970-01-01' + to_seconds(page_id * 7919 % 86400), '%H:%M:%S')"
    both = f"(strftime({day}, '%Y-%m-%d') || 'T' || {clock})"
    forms = [f"{both} || '+00:00'", f"{both} || 'Z'", f"{both} || '+05:30'", f"{both} || '.1234567'", f"strftime({day}, '%Y-%m-%d')",
             f"{both} || '-0800'", "'a while ago'", f"translate({both}, '-:', '') || 'Z'",
             f"strftime({day}, '%Y-%m-%d') || ' ' || left({clock}, 5)", f"{both} || '+25:00'"]
    cases = " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(forms))
    meta = ("CASE WHEN page_id % 11 = 10 THEN '</head>' ELSE '<meta property=\"article:published_time\" content=\"' || "
            f"CASE page_id % {len(forms)} {cases} END || '\"/></head>' END")
    return f"""SELECT page_id, url, replace(replace(replace(replace(html, '</head>', {meta}), '<article>',
    '<div class="teaser"><p>short of it</p></div><div title="a > b" class=''lead article-content''>'
    || '<p>n&#176; ' || page_id || ' of the day&#8217;s<br/>list &amp;#38; more</p><blockquote><p>said &#x201C;so&quot;</p></blockquote>'),
    '</article>', '<p>end</div></div><p>outside'),
    '<li><a href="/', '<li><a title="x > y" class="plain post-link" href="../a/./b?c=1&amp;d=')
    AS html FROM pages"""


def decoded(text: str) -> str:
    """Character references decoded, as `functions.markup.decode_references`."""
    from ..functions.markup import _C1, NAMED

    def literal(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    names = "MAP {" + ", ".join(f"{literal(k)}: {literal(v)}" for k, v in NAMED.items()) + "}"
    c1 = "MAP {" + ", ".join(f"{k}: {literal(v)}" for k, v in _C1.items()) + "}"
    number = "regexp_extract(x, '^#([0-9]+|[xX][0-9a-fA-F]+);?', 1)"
    digits = f"CASE WHEN lower({number}) LIKE 'x%' THEN CAST(CAST('0x' || substr({number}, 2) AS BIGINT) AS VARCHAR) ELSE {number} END"
    point = f"CAST({digits} AS BIGINT)"
    char = (f"CASE WHEN {point} BETWEEN 128 AND 159 THEN coalesce({c1}[{point}::INTEGER], chr({point}::INTEGER)) "
            f"WHEN {point} BETWEEN 1 AND 55295 OR {point} BETWEEN 57344 AND 1114111 THEN chr({point}::INTEGER) ELSE chr(65533) END")
    name = "regexp_extract(x, '^([A-Za-z][A-Za-z0-9]*);', 1)"
    return (f"array_to_string(list_transform(string_split({text}, '&'), lambda x, i: CASE WHEN i = 1 THEN x "
            f"WHEN {number} <> '' THEN {char} || regexp_replace(x, '^#([0-9]+|[xX][0-9a-fA-F]+);?', '') "
            f"WHEN {names}[{name}] IS NOT NULL THEN {names}[{name}] || regexp_replace(x, '^[A-Za-z0-9]+;', '') "
            f"ELSE '&' || x END), '')")


def attribute(tag: str, name: str) -> str:
    at = rf"""(?i)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""".replace("'", "''")
    value = " || ".join(f"regexp_extract({tag}, '{at}', {k})" for k in (1, 2, 3))
    return f"CASE WHEN regexp_matches({tag}, '{at}') THEN {decoded(f'({value})')} END"


def has_class(tag: str, wanted: str) -> str:
    value = f"coalesce({attribute(tag, 'class')}, '')"
    return f"({value} = '{wanted}' OR list_contains(regexp_split_to_array({value}, '\\s+'), '{wanted}'))"


def page_tokens(pages: str) -> str:
    """(page_id, url, i, tok): the pages' tags and texts in order."""
    from ..functions.markup import NOISE, TOKEN
    token = TOKEN.replace("'", "''")
    return (f"SELECT page_id, url, generate_subscripts(toks, 1) AS i, unnest(toks) AS tok FROM (SELECT page_id, url, "
            f"regexp_extract_all(regexp_replace(html, '{NOISE}', '', 'g'), '{token}') AS toks FROM ({pages}))")


def page_text(pages: str, block: str, block_class: str | None = None) -> str:
    """Titles and articles, by a recursion over each page's tokens with a stack."""
    from ..functions.markup import TAG_NAME, VOID
    wanted = f"AND {has_class('tok', block_class)}" if block_class else ""
    void = ", ".join(f"'{v}'" for v in VOID)
    return f"""WITH RECURSIVE t AS MATERIALIZED ({page_tokens(pages)}),
n AS (SELECT page_id, i, tok, regexp_matches(tok, '^</?[A-Za-z]') AS tag, lower(regexp_extract(tok, '{TAG_NAME}', 1)) AS name FROM t),
r AS MATERIALIZED (SELECT page_id, i, CASE WHEN tag THEN name END AS name, starts_with(tok, '</') AS fin,
        name IN ({void}) OR ends_with(tok, '/>') AS hollow, tag AND name = '{block}' {wanted} AS block,
        CASE WHEN tag OR regexp_matches(tok, '^<[!?]') THEN '' ELSE {decoded('tok')} END AS text FROM n),
s AS (SELECT page_id, 0 AS i, []::VARCHAR[] AS stack, -1 AS ta, -1 AS ba, -1 AS pa, 0 AS pars, '' AS title, '' AS body FROM ({pages})
  UNION ALL
  SELECT page_id, i, CASE WHEN name IS NULL THEN stack WHEN fin THEN stack[gone + 1:] WHEN hollow THEN stack ELSE list_prepend(name, stack) END,
    CASE WHEN name IS NULL THEN ta WHEN fin THEN CASE WHEN gone > 0 AND ta >= len(stack) - gone THEN -2 ELSE ta END
         WHEN name = 'h1' AND ta = -1 THEN CASE WHEN hollow THEN -2 ELSE len(stack) END ELSE ta END,
    CASE WHEN name IS NULL THEN ba WHEN fin THEN CASE WHEN gone > 0 AND ba >= len(stack) - gone THEN -2 ELSE ba END
         WHEN block AND ba = -1 THEN CASE WHEN hollow THEN -2 ELSE len(stack) END ELSE ba END,
    CASE WHEN name IS NULL THEN pa WHEN fin THEN CASE WHEN gone > 0 AND pa >= len(stack) - gone THEN -1 ELSE pa END
         WHEN direct AND NOT hollow THEN len(stack) ELSE pa END,
    CASE WHEN direct THEN pars + 1 ELSE pars END,
    CASE WHEN name IS NULL AND ta >= 0 THEN title || text ELSE title END,
    CASE WHEN name IS NULL AND pa >= 0 THEN body || text WHEN direct AND pars > 0 THEN body || ' ' ELSE body END
  FROM (SELECT s.*, r.* EXCLUDE (page_id, i), coalesce(list_position(stack, name), 0) AS gone,
          coalesce(name = 'p' AND NOT fin AND ba >= 0 AND len(stack) = ba + 1, FALSE) AS direct
        FROM (SELECT * REPLACE (i + 1 AS i) FROM s) s JOIN r ON r.page_id = s.page_id AND r.i = s.i)),
z AS (SELECT page_id, max(i) AS i FROM s GROUP BY page_id)
SELECT p.page_id, p.url, CASE WHEN ta <> -1 THEN title END AS title, CASE WHEN ba <> -1 THEN body END AS article
FROM ({pages}) p JOIN z ON z.page_id = p.page_id JOIN s ON s.page_id = z.page_id AND s.i = z.i"""


def resolved(base: str, ref: str) -> str:
    """An absolute URL, as `functions.markup.resolve_url` (RFC 3986, 5.2)."""
    uri = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

    def part(u, k):
        return f"regexp_extract({u}, '{uri}', {k})"

    authority = "regexp_matches({}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//')"
    ba, ra = authority.format(base), authority.format(ref)
    own = f"({part(ref, 1)} <> '' OR {ra})"

    def walked(path):
        rest = f"string_split(CASE WHEN starts_with({path}, '/') THEN substr({path}, 2) ELSE {path} END, '/')"
        # each `..` takes the nearest kept segment before it: counted by a running balance from the right
        kept = (f"list_reduce(list_prepend('', list_transform({rest}, lambda q: q || '/')), lambda a, q: CASE WHEN q = './' THEN a "
                f"WHEN q = '../' THEN regexp_replace(a, '[^/]*/$', '') ELSE a || q END)")
        last = f"{rest}[-1]"
        text = f"CASE WHEN {last} IN ('.', '..') THEN {kept} ELSE left({kept}, length({kept}) - 1) END"
        return f"(CASE WHEN starts_with({path}, '/') THEN '/' ELSE '' END || {text})"

    folder = f"regexp_replace({part(base, 3)}, '[^/]*$', '')"
    merged = f"(CASE WHEN {ba} AND {part(base, 3)} = '' THEN '/' ELSE {folder} END || {part(ref, 3)})"
    path = (f"CASE WHEN {own} OR starts_with({part(ref, 3)}, '/') THEN {walked(part(ref, 3))} "
            f"WHEN {part(ref, 3)} = '' THEN {part(base, 3)} ELSE {walked(merged)} END")
    has_query = "regexp_matches({}, '^[^?#]*\\?')"
    return (f"(CASE WHEN {part(ref, 1)} <> '' THEN {part(ref, 1)} || ':' WHEN {part(base, 1)} <> '' THEN {part(base, 1)} || ':' ELSE '' END "
            f"|| CASE WHEN {own} THEN CASE WHEN {ra} THEN '//' || {part(ref, 2)} ELSE '' END WHEN {ba} THEN '//' || {part(base, 2)} ELSE '' END "
            f"|| {path} || CASE WHEN {has_query.format(ref)} THEN '?' || {part(ref, 4)} "
            f"WHEN NOT {own} AND {part(ref, 3)} = '' AND {has_query.format(base)} THEN '?' || {part(base, 4)} ELSE '' END "
            f"|| CASE WHEN contains({ref}, '#') THEN '#' || {part(ref, 5)} ELSE '' END)")


def page_links(pages: str, link_class: str | None = None) -> str:
    wanted = f"AND {has_class('tok', link_class)}" if link_class else ""
    return f"""WITH t AS ({page_tokens(pages)}),
h AS (SELECT page_id, url AS base, i, {attribute('tok', 'href')} AS href FROM t WHERE regexp_matches(tok, '(?i)^<a[\\s/]') {wanted})
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, href,
  {resolved("coalesce(base, '')", 'trim(href)')} AS url, 'fixture' AS source FROM h WHERE href IS NOT NULL"""


def published(pages: str) -> str:
    """The publication time of each page's meta tag as UTC and Eastern wall time."""
    shape = (r"^(?:([0-9]{4})-([0-9]{2})-([0-9]{2})|([0-9]{4})([0-9]{2})([0-9]{2}))(?:[Tt ]([0-9]{2})(?::?([0-9]{2})(?::?([0-9]{2})"
             r"(?:[.,]([0-9]+))?)?)?)? ?(?:([Zz])|([+-])([0-9]{2})(?::?([0-9]{2}))?)?$")

    day = "replace(regexp_extract(s, '^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8})', 1), '-', '')"
    start = "^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8})[Tt ]"
    clock = f"replace(regexp_extract(s, '{start}([0-9:]+)', 1), ':', '')"
    zone = f"replace(regexp_extract(s, '{start}.*([+-][0-9]{{2}}(?::?[0-9]{{2}})?)$', 1), ':', '')"

    def digits(text, at):
        return f"coalesce(try_cast(substr({text}, {at}, 2) AS BIGINT), 0)"

    minutes = f"({digits(zone, 2)} * 60 + {digits(zone, 4)}) * CASE WHEN starts_with({zone}, '-') THEN -1 ELSE 1 END"
    micros = f"CAST(rpad(left(regexp_extract(s, '[.,]([0-9]+)', 1), 6), 6, '0') AS BIGINT)"
    return f"""WITH t AS ({page_tokens(pages)}),
m AS (SELECT page_id, {attribute('tok', 'content')} AS s, row_number() OVER (PARTITION BY page_id ORDER BY i) AS rk FROM t
      WHERE regexp_matches(tok, '(?i)^<meta[\\s/]') AND {attribute('tok', 'property')} = 'article:published_time'),
p AS (SELECT p.page_id, m.s FROM ({pages}) p LEFT JOIN m ON m.page_id = p.page_id AND rk = 1),
u AS (SELECT page_id, s AS published, CASE WHEN regexp_matches(s, '{shape}') AND {digits(zone, 2)} < 24 AND {digits(zone, 4)} < 60 THEN
        make_timestamp(CAST(left({day}, 4) AS BIGINT), {digits(day, 5)}, {digits(day, 7)}, {digits(clock, 1)}, {digits(clock, 3)}, {digits(clock, 5)})
        + to_microseconds({micros}) - to_minutes({minutes}) END AS time_utc FROM p)
SELECT page_id, published, time_utc, timezone('US/Eastern', timezone('UTC', time_utc)) AS time_et, CAST(time_utc AS DATE) AS date_utc,
  CAST(timezone('US/Eastern', timezone('UTC', time_utc)) AS DATE) AS date_et FROM u"""
