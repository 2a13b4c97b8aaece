"""Scalar normalisation as column expressions; all stay inside generated code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _letters() -> dict[str, str]:
    """Small Latin letters that are a plain letter with accents, from Unicode's own decompositions."""
    found = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", chr(code).lower())
        if base.isascii() and base.isalpha() and marks and len(chr(code).lower()) == 1:
            found[chr(code).lower()] = base
    return found


_PLAIN = _letters()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fold(x: Column | str) -> Column:
    """Lower case without accents, be they part of a letter or marks of their own."""
    return F.regexp_replace(F.translate(F.lower(_c(x)), "".join(_PLAIN), "".join(_PLAIN.values())), "[\u0300-\u036f]", "")


def digits(x: Column | str) -> Column:
    return F.regexp_replace(_c(x).cast("string"), r"\D", "")


def padded_id(x: Column | str, width: int = 14) -> Column:
    """Digits left-padded with zeros; an id without digits is null."""
    d = digits(x)
    return F.when(F.length(d) > 0, F.lpad(d, width, "0"))


def formatted_id(x: Column | str) -> Column:
    """``00.000.000/0000-00``"""
    return F.regexp_replace(padded_id(x), r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", r"$1.$2.$3/$4-$5")


def matches_entity(name: Column | str, ident: Column | str, term: str) -> Column:
    """Folded name contains the term, or the digits of id and term are equal."""
    plain = fold(F.lit(term))
    number = digits(F.lit(term))
    return F.contains(fold(name), plain) | ((F.length(number) > 0) & (digits(ident) == number))


def between(x: Column | str, low=None, high=None) -> Column:
    """Range filter whose bounds may be missing."""
    out = F.lit(True)
    if low is not None:
        out = out & (_c(x) >= low)
    if high is not None:
        out = out & (_c(x) <= high)
    return out


def one_of(x: Column | str, values) -> Column:
    """Membership; no values means no filter."""
    return _c(x).isin(list(values)) if values else F.lit(True)


def scaled_amount(value: Column | str, scale: Column | str) -> Column:
    """Text amount to double; the scale MIL means thousands; bad text is null."""
    return _c(value).try_cast("double") * F.when(F.upper(F.trim(_c(scale))) == "MIL", 1000.0).otherwise(1.0)


def sig_round(x: Column | str, significant: int = 6) -> Column:
    """Round to significant digits, never to fewer than two decimals."""
    v = _c(x)
    places = F.greatest(F.lit(2), F.lit(significant - 1) - F.floor(F.log10(F.abs(v))).cast("int"))
    power = F.pow(F.lit(10.0), places)
    return F.when(v == 0, 0.0).when(v.isNull() | F.isnan(v), None).otherwise(F.round(v * power) / power)


def finite(x: Column | str) -> Column:
    """NaN and infinities become null."""
    v = _c(x)
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def quarter_label(d: Column | str) -> Column:
    return F.concat(F.year(_c(d)).cast("string"), F.lit("T"), F.quarter(_c(d)).cast("string"))


def period_kind(start: Column | str, is_balance: Column) -> Column:
    """saldo for balances, acumulado for periods that start on 1 January, else trimestre."""
    s = _c(start)
    return F.when(is_balance | s.isNull(), "saldo").when((F.month(s) == 1) & (F.dayofmonth(s) == 1), "acumulado").otherwise("trimestre")


def whole_word(text: Column | str, term: Column | str) -> Column:
    """The folded term occurs between non-alphanumerics (the term is literal)."""
    t = fold(term)
    literal = F.regexp_replace(t, r"([^a-z0-9 ])", r"\\$1")
    return (F.length(t) > 0) & F.rlike(F.concat(F.lit(" "), fold(text), F.lit(" ")), F.concat(F.lit("[^a-z0-9]"), literal, F.lit("[^a-z0-9]")))


def all_words(text: Column | str, query: str, ident: Column | str | None = None) -> Column:
    """Every word of the query is contained; a query of 8 digits or more may also match the id's digits."""
    words = [w for w in query.split() if w]
    plain = fold(text)
    out = F.lit(True)
    for w in words:
        out = out & F.contains(plain, fold(F.lit(w)))
    number = "".join(c for c in query if c.isdigit())
    return out | F.contains(digits(ident), F.lit(number)) if ident is not None and len(number) >= 8 else out


def _marks(x: Column) -> Column:
    """1,234.5 -> 1.234,5"""
    return F.translate(x, ",.", ".,")


def compact_number(x: Column | str) -> Column:
    """1,23 mi and the like: mil, mi, bi."""
    v = _c(x)
    a = F.abs(v)
    band = lambda d, unit: F.concat(_marks(F.format_number(v / d, 2)), F.lit(unit))
    return F.when(a >= 1e9, band(1e9, " bi")).when(a >= 1e6, band(1e6, " mi")).when(a >= 1e3, band(1e3, " mil")).otherwise(_marks(F.format_number(v, 2)))


def currency(x: Column | str) -> Column:
    return F.concat(F.lit("R$ "), compact_number(x))


def first_sentence(x: Column | str, limit: int = 180) -> Column:
    """Up to the first sentence end, else cut at a word with a mark."""
    v = F.trim(_c(x))
    s = F.regexp_extract(v, rf"(?s)^(.{{0,{limit}}}?[.;])(?=\s|$)", 1)
    return F.when(F.length(s) > 0, s).otherwise(ellipsis(v, limit))


def ellipsis(x: Column | str, limit: int) -> Column:
    v = _c(x)
    return F.when(F.length(v) <= limit, v).otherwise(F.concat(F.rtrim(F.regexp_extract(v, rf"(?s)^(.{{1,{limit - 1}}})(?=\s)", 1)), F.lit("…")))


def clean_text(x: Column | str) -> Column:
    """Hyphenated line breaks joined, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(x), r"(\p{L})-\s*\n\s*(\p{Ll})", "$1$2"), r"\s+", " "))


def title_parts(x: Column | str) -> Column:
    """'name (dd/mm/yyyy): subject' -> struct(date, subject)."""
    v = _c(x)
    return F.struct(F.try_to_date(F.regexp_extract(v, r"\((\d{2}/\d{2}/\d{4})\)", 1), "dd/MM/yyyy").alias("date"), F.trim(F.regexp_extract(v, r"\):\s*(.*)$", 1)).alias("subject"))


def first_url(x: Column | str) -> Column:
    u = F.regexp_extract(_c(x), r"https?://[^\s)\]>\"']+", 0)
    return F.nullif(F.regexp_replace(u, r"[.,;:]+$", ""), F.lit(""))


def route(path: Column | str) -> Column:
    """Low-cardinality form of a request path: scheme, host and query cut; ids become :id."""
    p = F.regexp_replace(F.regexp_replace(_c(path), r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    p = F.regexp_replace(p, r"/[0-9a-fA-F]{8}-[0-9a-fA-F-]{27}(?=/|$)", "/:id")
    p = F.regexp_replace(p, r"/(?:[0-9a-f]{24}|\d+)(?=/|$)", "/:id")
    return F.when(F.length(p) == 0, "/").otherwise(p)


#: Fixed values, in order: what a path looks like; ``#id`` and the like stand for one segment.
TEMPLATES = (
    "/api/agents/chat/stream/#id", "/api/agents/chat/status/#id", "/api/files/code/download/#id/#id", "/api/files/download-url/#id/#id", "/api/files/download/#id/#id", "/api/files/#id/preview",
    "/api/skills/#id/files", "/api/messages/artifact/#id", "/api/messages/#id/#id", "/api/convos/#id/messages/#id", "/api/messages/#id", "/api/convos/#id", "/api/files/#id", "/api/agents/#id",
    "/api/assistants/#id", "/api/share/#token", "/share/#id",
)
#: Prefixes of what no template knows.
FALLBACKS = ("/api", "/images", "/avatars", "/t")


def templated(path: Column | str, templates: tuple[str, ...] = TEMPLATES, known: tuple[str, ...] = ("/",), fallbacks: tuple[str, ...] = FALLBACKS) -> Column:
    """Path without its query as the first template that it is or begins like; a known path as it is; else its first fallback prefix with ``#path``, or ``/#path``."""
    p = F.regexp_replace(_c(path), r"\?.*$", "")
    p = F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p))
    out = None
    like = lambda t: "^" + "/".join("[^/]+" if x.startswith("#") else x for x in t.split("/")) + "(?=/|$)"
    for t in templates:
        hit = p.rlike(like(t))
        out = F.when(hit, F.lit(t)) if out is None else out.when(hit, F.lit(t))
    found = F.when(p.isin(*known), p).when(out.isNotNull(), out)
    for f in fallbacks:
        found = found.when((p == f) | F.startswith(p, F.lit(f + "/")), F.lit(f + "/#path"))
    return F.when(p.isNotNull(), found.otherwise("/#path"))


def _decimal(x: Column, places: int) -> Column:
    """1.234,5 with the last place rounded half away from zero; ``places`` is the most, zeros at the end go."""
    text = F.format_number(F.round(x, places), places)
    return _marks(F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "") if places else text)


def compact(x: Column | str) -> Column:
    """1.284, 12,9 mil, 4,2 mi, 3,1 bi: one decimal above ten thousand and from ten to a hundred, none between, two below ten."""
    v = _c(x)
    a = F.abs(v)
    unit = lambda d, u: F.concat(_decimal(v / d, 1), F.lit(u))
    return F.when(a >= 1e9, unit(1e9, " bi")).when(a >= 1e6, unit(1e6, " mi")).when(a >= 1e4, unit(1e3, " mil")).when(a >= 100, _decimal(v, 0)).when(a >= 10, _decimal(v, 1)).otherwise(_decimal(v, 2))


#: Unit -> (text before, None for a compact number or its decimals, text after).
UNITS = {"brl": ("R$ ", None, ""), "pct": ("", 1, "%"), "x": ("", 2, "x"), "h": ("", 2, " h"), "brl_mwh": ("R$ ", 2, "/MWh"), "mw": ("", None, " MW"), "mwh": ("", None, " MWh"), "mwmed": ("", None, " MWmed"), "mwmes": ("", None, " MWm\u00eas")}


def with_unit(x: Column | str, unit: Column | str) -> Column:
    """A number as text with its unit; an unknown unit gives the compact number, no number a dash."""
    v, u = _c(x), _c(unit)
    out = None
    for name, (before, places, after) in UNITS.items():
        text = F.concat(F.lit(before), compact(v) if places is None else _decimal(v, places), F.lit(after))
        out = F.when(u == name, text) if out is None else out.when(u == name, text)
    return F.when(v.isNull(), "\u2013").otherwise(out.otherwise(compact(v)))


def is_blank(x: Column | str) -> Column:
    return _c(x).isNull() | _c(x).isin("", "null")


def parts_text(content: Column | str) -> Column:
    """Text of an array of parts with type and text."""
    return F.concat_ws(" ", F.transform(F.filter(_c(content), lambda p: p["type"] == "text"), lambda p: p["text"]))


def status_label(operational: Column | str, planned: Column | str) -> Column:
    return F.when(F.coalesce(_c(operational), F.lit(False)), "operating").when(F.coalesce(_c(planned), F.lit(False)), "planned").otherwise("unknown")


def scaled_map(rates: Column | str, factor: float) -> Column:
    """Every value times the factor; zero entries go."""
    return F.transform_values(F.map_filter(_c(rates), lambda _, v: v != 0), lambda _, v: v * factor)


def plus_interval(t: Column | str, n: Column | str, unit: str) -> Column:
    """A timestamp plus n units (seconds ... months)."""
    v, n = _c(t), _c(n)
    if unit == "months":
        return F.add_months(v, n.cast("int")).cast("timestamp") + (v - F.date_trunc("day", v))
    width = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400, "weeks": 604800}[unit]
    return F.timestamp_micros(F.unix_micros(v) + n.cast("long") * width * 1_000_000)
