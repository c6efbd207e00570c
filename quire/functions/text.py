"""String, path, hash and vector functions as Column expressions: all run inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with a stroke or another form, which Unicode doesn't take apart, and their plain forms, position by position.
STROKED = "đðłøı"
STROKED_PLAIN = "ddloi"
MARKS = "[\u0300-\u036f]"


def _decomposed() -> dict[str, str]:
    """Small letters of any script that Unicode takes apart into one letter and accents -> that letter."""
    out = {}
    for c in map(chr, range(0x80, 0x20000)):
        own = unicodedata.normalize("NFD", c)
        if len(own) > 1 and c == c.lower():
            base = "".join(x for x in own if not "\u0300" <= x <= "\u036f")
            if len(base) == 1:
                out[c] = base
    return out


FOLDED = _decomposed() | dict(zip(STROKED, STROKED_PLAIN, strict=True))
# Letters that fold to two.
TWO_LETTERS = {"æ": "ae", "œ": "oe", "ß": "ss", "þ": "th"}
# Phrases that head the licence division of an electronic edition.
LICENCE_PHRASES = ("the full project gutenberg license", "à propos de cette édition électronique", "ende dieses projekt gutenberg etextes", "questo e-book è stato realizzato")

MAX_SCOPES = 32
MAX_SCOPE_LENGTH = 500


def squeeze(c: Column) -> Column:
    """White space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def ellipsis(c: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def preview(c: Column, n: int = 280) -> Column:
    return ellipsis(squeeze(c), n, "…")


def fold(c: Column) -> Column:
    """Lower case without accents, in any script whose letters Unicode takes apart; Latin letters end in ASCII."""
    out = F.translate(F.regexp_replace(F.lower(c), MARKS, ""), "".join(FOLDED), "".join(FOLDED.values()))
    for letter, plain in TWO_LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def folded(s: str) -> str:
    """fold() of a Python string."""
    out = "".join(x for x in s.lower() if not "\u0300" <= x <= "\u036f").translate(str.maketrans(FOLDED))
    for letter, plain in TWO_LETTERS.items():
        out = out.replace(letter, plain)
    return out


def tokens(c: Column) -> Column:
    """Runs of letters and digits of the folded text: the terms of the generic analyzer, without stop words or stemming."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def contains_ci(c: Column, q: str) -> Column:
    """Case-insensitive substring, nothing in q special."""
    return F.contains(F.lower(c), F.lit(q.lower()))


def like_ci(c: Column, q: str) -> Column:
    """Case-insensitive LIKE %q%, in which % and _ of q stay wildcards."""
    return F.lower(c).like(f"%{q.lower()}%")


def heading_normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[\p{Punct}\s]+", " "))


def is_licence(head: Column) -> Column:
    low = squeeze(F.lower(head))
    found = F.lit(False)
    for phrase in LICENCE_PHRASES:
        found = found | F.contains(low, F.lit(phrase))
    return F.coalesce(found, F.lit(False))


def is_x_marked(head: Column) -> Column:
    """Headings such as [x] or /xx/, whose division is left out with all below it."""
    return F.coalesce(head.rlike(r"(?i)^.*?[\[|/]x+[\]|/].*$"), F.lit(False))


def visual_name(display: Column, first: Column, last: Column) -> Column:
    return F.coalesce(display, F.when(first.isNull(), last).otherwise(F.concat_ws(" ", first, last)))


def parsed_name(original: Column) -> Column:
    """struct(last, first): "Last, First", or the last of several words first; what is left of three words or more comes in the parsed order."""
    name = F.trim(original)
    by_comma = F.transform(F.split(name, ","), lambda x: F.trim(x))
    by_space = F.reverse(F.split(name, r"\s+"))
    parts = F.when(F.contains(name, F.lit(",")), by_comma).otherwise(by_space)
    rest = F.trim(F.array_join(F.filter(parts, lambda x, i: i > 0), " "))
    return F.struct(parts[0].alias("last"), F.when(F.size(parts) > 1, rest).alias("first"))


def name_key(original: Column) -> Column:
    """Words of a name, folded and sorted: equal for its spellings. Empty for a blank name."""
    words = F.split(F.trim(F.regexp_replace(fold(F.coalesce(original, F.lit(""))), r"[^\p{Alnum}]+", " ")), r"\s+")
    return F.array_join(F.array_sort(words), " ")


def path_fragments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def basename(path: Column) -> Column:
    """Up to the first dot of the whole path."""
    return F.substring_index(path, ".", 1)


def extension(path: Column) -> Column:
    """After the last dot, null if there is none."""
    return F.when(F.contains(path, F.lit(".")), F.substring_index(path, ".", -1))


def canonical_path(path: Column) -> Column:
    """Without query, fragment, empty segments and the extension of the last segment; one leading slash."""
    own = F.regexp_replace(F.coalesce(path, F.lit("")), r"[?#].*$", "")
    joined = F.array_join(path_fragments(own), "/")
    return F.concat(F.lit("/"), F.regexp_replace(joined, r"\.[^./]*$", ""))


def url_path(url: Column) -> Column:
    """The decoded path of a URL up to its first dot, with a leading slash."""
    raw = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][\w+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    return F.concat(F.lit("/"), F.regexp_replace(basename(F.try_url_decode(raw)), "^/+", ""))


def endpoint(url: Column) -> Column:
    """struct(scheme, host, port)."""
    part = lambda i: F.nullif(F.regexp_extract(url, r"^(?:([a-zA-Z][\w+.-]*)://)?([^:/?#]+)(?::(\d+))?", i), F.lit(""))
    return F.struct(part(1).alias("scheme"), part(2).alias("host"), part(3).try_cast("int").alias("port"))


def normal_scopes(raw: list[str] | None) -> list[str]:
    """Distinct scopes in order, or ValueError for one that isn't a path of two segments or more."""
    out: list[str] = []
    for scope in raw or []:
        own = scope.strip().strip("/")
        if not own:
            continue
        wrong = len(own) > MAX_SCOPE_LENGTH or "/" not in own or any(x in own for x in ("//", "..", "?", "#")) or any(s.startswith(".") for s in own.split("/"))
        if wrong:
            raise ValueError(f"bad scope: {scope!r}")
        if own not in out:
            out.append(own)
    if len(out) > MAX_SCOPES:
        raise ValueError(f"more than {MAX_SCOPES} scopes")
    return out


def in_scope(path: Column, scopes: list[str]) -> Column:
    """Whether the path (without leading slashes and a text extension) is a scope or lies under one; no scopes pass all."""
    if not scopes:
        return F.lit(True)
    own = F.regexp_replace(F.regexp_replace(path, "^/+", ""), r"\.(txt|xml|json|xhtml)$", "")
    found = F.lit(False)
    for s in scopes:
        found = found | (own == s) | F.startswith(own, F.lit(s + "/"))
    return found


def prefixes(path: Column) -> Column:
    """The path and its ancestors down to two segments, longest first: turns prefix joins into equi-joins."""
    parts = path_fragments(path)
    return F.transform(F.reverse(F.sequence(F.least(F.lit(2), F.size(parts)), F.size(parts))), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))


def text_digest(head: Column, text: Column) -> Column:
    """SHA-256 of the squeezed text without its leading heading."""
    own, title = squeeze(text), squeeze(F.coalesce(head, F.lit("")))
    led = (title != "") & F.startswith(own, title)
    return F.sha2(F.when(led, F.trim(F.substr(own, F.length(title) + 1))).otherwise(own), 256)


def word_size(text: Column) -> Column:
    """Words of the squeezed text; 1 for an empty one, as splitting gives."""
    return F.size(F.split(squeeze(text), r"\s+"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of words; 1 if one holds the other, 0 if either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(a, b))
    inner = (both == F.size(a)) | (both == F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).when(inner, 1.0).otherwise(both / F.size(F.array_union(a, b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def rounded(c: Column, places: int) -> Column:
    """A double rounded half away from zero as DuckDB does it: scaled, rounded, scaled back; what rounds to zero keeps its sign."""
    scale = F.lit(10.0**places)
    return F.signum(c) * F.abs(F.round(c * scale, 0) / scale)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def backoff_hours(attempts: Column) -> Column:
    """1, 2, 4, ... hours, a day at most."""
    return F.least(F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(10))), F.lit(24.0))


def escape_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_html(c: Column) -> Column:
    """For text and attributes of HTML: as for XML, but the single quote is a number."""
    return F.replace(escape_xml(c), F.lit("&apos;"), F.lit("&#39;"))


def escape_quoted(c: Column) -> Column:
    """For a literal in single quotes of a vector store's filter."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def escape_query(c: Column) -> Column:
    """A backslash before what a Lucene-style query syntax would read as an operator."""
    return F.regexp_replace(c, r'([+\-!(){}\[\]^"~*?:\\/|&])', r"\\$1")


def byte_truncate(c: Column, n: int) -> Column:
    """The longest prefix of at most n bytes in UTF-8 that ends with a whole character."""
    cut = F.make_valid_utf8(F.substring(F.encode(c, "UTF-8"), 1, n).cast("string"))
    return F.when(F.octet_length(c) <= n, c).otherwise(F.regexp_replace(cut, "\ufffd+$", ""))


def binary_object(encoded: Column) -> Column:
    return F.unbase64(F.regexp_replace(encoded, r"\s", ""))


def event_details(**details: Column) -> Column:
    """A map of strings without the null ones."""
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


# Browsers that run a reader's application, and clients that only look like them.
MODERN_BROWSER = r"(?i)Chrome/|Chromium/|CriOS/|Edg/|OPR/|Firefox/|FxiOS/|Safari/"
NO_BROWSER = r"(?i)bot|crawl|spider|curl|wget|python-requests|httpclient|okhttp|libwww|lynx|links|w3m|postman|axios|go-http-client|java/"
# First path segments that are no authors.
RESERVED = ("css", "img", "js", "api", "util", "search", "p", "admin", "app", "v2", "v3", "webjars", "swagger-ui", "swagger-ui.html", "quote", "dav")


def is_modern_browser(agent: Column) -> Column:
    return F.coalesce((F.trim(agent) != "") & agent.rlike(MODERN_BROWSER) & ~agent.rlike(NO_BROWSER), F.lit(False))


def is_author_slug(c: Column) -> Column:
    return F.coalesce(c.rlike("^[a-z0-9_]+$") & ~c.isin(*RESERVED), F.lit(False))


def is_work_slug(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-z0-9_.]+$"), F.lit(False))


def is_source_path(c: Column) -> Column:
    """A path of a fragment's source: 2000 characters at most, without query, anchor or dot segments."""
    dots = F.exists(F.split(c, "/"), lambda s: s.isin(".", ".."))
    return F.coalesce((F.length(c) <= 2000) & ~c.rlike("[?#]") & ~dots, F.lit(False))


def is_revision(c: Column) -> Column:
    return F.coalesce(c.rlike("^[a-f0-9]{64}$"), F.lit(False))


def point_id(sha256: Column) -> Column:
    """The id of a vector store's point: the first 32 hex digits of the digest, as a UUID."""
    return F.regexp_replace(F.substring(sha256, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def relative_root(path: Column) -> Column:
    """From a path back to the top: "/.." for each of its segments."""
    return F.repeat(F.lit("/.."), F.size(path_fragments(path)))


def rfc1123(at: Column) -> Column:
    """A date as in HTTP headers, of a timestamp in UTC."""
    return F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def int_path(c: Column) -> Column:
    """The numbers of a dotted path; null if it is none."""
    return F.when(c.rlike(r"^\d+(\.\d+)*$"), F.transform(F.split(c, r"\."), lambda x: x.cast("int")))


def relevant(text: Column, pattern: str) -> Column:
    """Whether a judged query's regular expression, in any case, finds the text relevant."""
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def preferences(c: Column) -> Column:
    """A JSON object as stored, {} where it is bad or none; null where it is too long to store."""
    good = F.when(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), c)
    return F.when(F.length(c) > 100_000, F.lit(None)).otherwise(F.coalesce(good, F.lit("{}")))


def sha3(c: Column) -> Column:
    """SHA3-256 in hex, which the JVM functions don't have."""
    import hashlib

    @F.pandas_udf("string")
    def digest(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hashlib.sha3_256(x.encode()).hexdigest())

    return digest(c)
