"""Text functions: tokens, similarity, affixes, titles, surfaces, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Anything but letters, digits and underscore, in any script.
NONWORD = r"[^\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Distinct lower-case word tokens; a text that begins with ``_`` is one token, kept as it is."""
    split = F.array_distinct(F.filter(F.split(F.lower(text), NONWORD), lambda t: t != ""))
    return F.when(text.startswith("_"), F.array(text)).otherwise(split)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; null if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both)


def edit_similarity(a: Column, b: Column) -> Column:
    """``max(0, (m - distance) / m)`` with m the shorter length."""
    m = F.least(F.length(a), F.length(b))
    return F.when(m > 0, F.greatest(F.lit(0.0), (m - F.levenshtein(a, b)) / m))


def plain_number(text: Column) -> Column:
    """A double after thousands separators are dropped and a typographic minus replaced; null if it is none."""
    return F.replace(F.replace(text, F.lit(","), F.lit("")), F.lit("−"), F.lit("-")).try_cast("double")


def looks_number(text: Column) -> Column:
    """Test of a number as column typing applies it: ``,`` and ``.`` ignored."""
    return F.regexp_replace(F.lower(text), "[,.]", "").rlike(r"^\s*[+−-]?[0-9]+(e[+-]?[0-9]+)?\s*$")


def numeric_share(text: Column) -> Column:
    """Share of digits among the characters."""
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit("[0-9]")) / F.length(text)).otherwise(F.lit(0.0))


YEAR = r"^[0-9]{4}([-–—][0-9]{2,4})?$"


def is_year(text: Column) -> Column:
    return text.rlike(YEAR)


def parsed_date(text: Column) -> Column:
    """First of the strict formats that fits, as a date."""
    year = F.when(text.rlike(r"^[0-9]{4}$"), F.concat(text, F.lit("-01-01")))
    tries = [F.try_to_date(text, fmt) for fmt in ("yyyy-MM-dd", "d MMMM yyyy", "MMMM d, yyyy", "dd/MM/yyyy", "d MMM yyyy", "yyyy/MM/dd")]
    return F.coalesce(F.try_to_date(year, "yyyy-MM-dd"), *tries)


def numeric_closeness(a: Column, b: Column) -> Column:
    """``1 - |a-b| / max(|a|,|b|)``; 1 if both are 0."""
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top > 0, F.greatest(F.lit(0.0), 1 - F.abs(a - b) / top)).when(top == 0, F.lit(1.0))


def date_closeness(a: Column, b: Column) -> Column:
    """``1 - days / 365``, 0 at least."""
    return F.greatest(F.lit(0.0), 1 - F.abs(F.datediff(a, b)) / 365)


def literal_match(surface: Column, literal: Column, datatype: Column, stringmatch: str = "jaccard") -> Column:
    """Score of a cell against a typed literal; null where it does not match."""
    number = numeric_closeness(plain_number(surface), plain_number(literal))
    date = date_closeness(parsed_date(surface), parsed_date(literal))
    loose = jaccard(F.array_distinct(F.split(F.lower(surface), r"\s+")), F.array_distinct(F.split(F.lower(literal), r"\s+"))) if stringmatch == "jaccard" else edit_similarity(F.lower(surface), F.lower(literal))
    return (
        F.when(datatype == "dateTime", F.when(date > 0, date)).when(datatype == "decimal", F.when(number > 0.95, number))
        .when(datatype.isNotNull(), F.when(F.lower(surface) == F.lower(literal), F.lit(1.0))).otherwise(F.when(loose > 0, loose))
    )


def common_prefix_length(low: Column, high: Column) -> Column:
    """Of the smallest and largest text of a set: that of the whole set."""
    n = F.least(F.length(low), F.length(high))
    return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), n), lambda i: F.substr(low, F.lit(1), i) == F.substr(high, F.lit(1), i))), F.lit(0))


def query_parts(text: Column) -> Column:
    """A label and its parts: cut at ``( [ , :`` and freed of closing brackets."""
    return F.array_distinct(F.filter(F.transform(F.split(text, r"[(\[,:]"), lambda p: F.trim(F.translate(p, ")]", ""))), lambda p: p != ""))


def title_key(title: Column) -> Column:
    """Normal form of a page title: URL-decoded, underscores as spaces, lower case."""
    return F.lower(F.replace(F.try_url_decode(title), F.lit("_"), F.lit(" ")))


def surface_key(text: Column) -> Column:
    """Everything but letters, digits, underscore and space as a space."""
    return F.regexp_replace(text, r"[^\s\p{L}\p{N}_]", " ")


def surfaces_of_uri(uri: Column) -> Column:
    """Surface forms that an entity's URI suggests: its last segment, without ``(...)``, and without ``, ...``."""
    name = F.replace(F.try_url_decode(last_segment(uri)), F.lit("_"), F.lit(" "))
    bare = F.trim(F.regexp_replace(name, r"\s*\(.*?\)", ""))
    short = F.when(~bare.rlike(r"\band\b|&"), F.trim(F.regexp_replace(bare, r",.*$", ""))).otherwise(bare)
    return F.array_distinct(F.array(name, bare, short))


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def domain(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)


def link_type(href: Column) -> Column:
    """PAGE, INTERNAL, EXTERNAL or UNKNOWN."""
    return (
        F.when(href.isNull() | (href == ""), "UNKNOWN").when(href.startswith("#"), "PAGE").when(href.contains("wikipedia.org"), "INTERNAL")
        .when(href.startswith("http"), "EXTERNAL").otherwise("INTERNAL")
    )


def refcount_score(count: Column) -> Column:
    """``1 - 1 / (1 + count)``: 0 without references, towards 1 with many."""
    return 1 - 1 / (1 + count)


def repaired(text: Column, rounds: int = 3) -> Column:
    """Text that was UTF-8 but read as Latin-1, set right where that can be told."""
    for _ in range(rounds):
        again = F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string"))
        fits = ~text.rlike("[^\u0000-ÿ]") & text.rlike("[\u0080-ÿ]")
        text = F.when(fits, F.coalesce(again, text)).otherwise(text)
    return text


def header_id(texts: Column) -> Column:
    """63-bit id of a header: hash of its texts, joined by a separator that no cell holds."""
    digest = F.md5(F.array_join(F.transform(texts, lambda t: F.coalesce(t, F.lit(""))), "\u001f"))
    return (F.conv(F.substring(digest, 1, 15), 16, 10)).cast("bigint")


def minhash(items: Column, slots: int = 128) -> Column:
    """Signature: per slot the smallest seeded hash of any item."""
    return F.transform(F.sequence(F.lit(1), F.lit(slots)), lambda i: F.array_min(F.transform(items, lambda t: F.xxhash64(t, i))))


def minhash_estimate(a: Column, b: Column) -> Column:
    """Share of equal slots."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector divided by its Euclidean length; null for a zero vector."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def wiki_url(page: Column, language: str = "en", curid: Column | None = None) -> Column:
    """The URL of a wiki page by its title."""
    url = F.concat(F.lit(f"http://{language}.wikipedia.org/wiki/"), F.replace(page, F.lit(" "), F.lit("_")))
    return url if curid is None else F.concat(url, F.lit("?curid="), curid.cast("string"))


def unicode_escaped(text: Column) -> Column:
    """Characters over U+007E as ``\\uXXXX`` (as surrogate pairs over U+FFFF)."""
    raw = F.transform(F.split(text, ""), lambda c: F.when(c.rlike("[\u0000-\u007e]") | (c == ""), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-16BE")), "(.{4})", r"\\u$1")))
    return F.array_join(raw, "")


def rdf_node(value: Column, kind: Column, datatype: Column, language: Column) -> Column:
    """A term as N-Triples write it: ``<uri>``, or a quoted literal with its language or data type."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), F.lit('"'))
    tail = F.when(language.isNotNull(), F.concat(F.lit("@"), language)).when(datatype.isNotNull(), F.concat(F.lit("^^<"), datatype, F.lit(">"))).otherwise("")
    return F.when(kind == "uri", F.concat(F.lit("<"), value, F.lit(">"))).otherwise(F.concat(quoted, tail))


def links_within(links: Column, start: Column, end: Column) -> Column:
    """Links (start, end, href) of a text that lie in its part from ``start`` to ``end``, by offsets in that part; those cut by its edges are left out."""
    inside = F.filter(links, lambda k: (k["start"] >= start) & (k["end"] <= end))
    return F.transform(inside, lambda k: F.struct((k["start"] - start).alias("start"), (k["end"] - start).alias("end"), k["href"].alias("href")))


def links_joined(first: Column, length: Column, second: Column) -> Column:
    """Links of two texts put one after the other: the second's move by the first's length."""
    return F.concat(first, F.transform(second, lambda k: F.struct((k["start"] + length).alias("start"), (k["end"] + length).alias("end"), k["href"].alias("href"))))


def with_anchors(text: Column, links: Column) -> Column:
    """The text as HTML, each link (in order, not overlapping) an anchor."""
    part = lambda a, b: F.substring(text, a + 1, b - a)
    before = lambda i: F.when(i > 0, F.get(links, i - 1)["end"]).otherwise(0)
    seen = F.transform(links, lambda k, i: F.concat(part(before(i), k["start"]), F.lit('<a href="'), k["href"], F.lit('">'), part(k["start"], k["end"]), F.lit("</a>")))
    return F.concat(F.array_join(seen, ""), part(F.coalesce(F.get(links, F.size(links) - 1)["end"], F.lit(0)), F.length(text)))
