"""Text functions as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Key names whose values are secrets.
SECRET_KEYS = (
    "api_key", "apikey", "authorization", "auth", "token", "access_token", "secret", "password", "groq_api_key",
    "openai_api_key", "anthropic_api_key", "embedding_api_key", "x-api-key", "app_secret_key",
)
#: Patterns of secrets, and what takes their place.
BEARER = r"(?i)bearer\s+[A-Za-z0-9._\-]+"
KEY_LIKE = r"\b(sk|gsk|xai|or)-[A-Za-z0-9._\-]{8,}\b"
REDACTED = "[REDACTED]"
#: First bytes of known file types.
SIGNATURES = (("application/pdf", "255044462D"), ("image/png", "89504E470D0A1A0A"), ("image/jpeg", "FFD8FF"), ("image/tiff", "49492A00"), ("image/tiff", "4D4D002A"))


def quoted_pattern(text: str) -> str:
    """A regular expression that matches just the text."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", text)


def strip(t: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def normalize(t: Column) -> Column:
    """Lower case, white space as single blanks, stripped; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), r"(?U)\s+", " "))


def paragraphs(t: Column) -> Column:
    """Parts between blank lines, stripped, empty ones dropped."""
    return F.filter(F.transform(F.split(t, r"\n\s*\n"), strip), lambda p: p != "")


def token_estimate(t: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(t) / 4).cast("int"))


def occurrences(t: Column, k: Column) -> Column:
    """How often k stands in t without overlap; 0 for an empty k."""
    n = F.length(k)
    return F.when(n > 0, ((F.length(t) - F.length(F.replace(t, k, F.lit("")))) / n).cast("long")).otherwise(F.lit(0).cast("long"))


def query_terms(q: Column) -> Column:
    """Lower-cased words of a query in order, repeats kept."""
    return F.filter(F.split(F.lower(F.coalesce(q, F.lit(""))), r"(?U)\s+"), lambda x: x != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def counted(values: Column) -> Column:
    """Array of (value, n): each value of an array in order, with its number."""

    def pairs(ordered: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(ordered)), lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2)))

        def ends(first: Column) -> Column:
            after = lambda k: F.coalesce(F.get(first, k + 1), F.size(ordered) + 1)
            return F.transform(first, lambda i, k: F.struct(F.get(ordered, i - 1).alias("value"), (after(k) - i).cast("long").alias("n")))

        return F.when(F.size(ordered) > 0, let(places, ends))

    return let(F.array_sort(values), pairs)


def safe_filename(name: Column, default: str = "file") -> Column:
    """Only letters, digits, dot, underscore and dash; at most 200 characters."""
    clean = F.regexp_replace(F.replace(strip(name), F.lit("\x00"), F.lit("")), r"[^A-Za-z0-9._-]+", "_")
    bare = F.regexp_replace(clean, r"^[._]+|[._]+$", "")
    return F.substring(F.when(bare == "", F.lit(default)).otherwise(bare), 1, 200)


def redact(t: Column) -> Column:
    """Bearer tokens and key-like strings replaced."""
    return F.regexp_replace(F.regexp_replace(t, BEARER, f"Bearer {REDACTED}"), KEY_LIKE, REDACTED)


def redact_map(m: Column) -> Column:
    """Values of secret keys replaced, the others redacted as text."""
    return F.transform_values(m, lambda k, v: F.when(F.lower(k).isin(*SECRET_KEYS), F.lit(REDACTED)).otherwise(redact(v)))


def mask(secret: Column) -> Column:
    """Four stars and the last four characters; empty for nothing."""
    s = F.coalesce(secret, F.lit(""))
    return F.when(s == "", F.lit("")).when(F.length(s) >= 4, F.concat(F.lit("****"), F.right(s, F.lit(4)))).otherwise(F.lit("****"))


def title_from_path(path: Column) -> Column:
    """Title from the last part of a URL or path: decoded, without extension,
    dashes and underscores as blanks; null if nothing is left."""
    inner = F.regexp_extract(path, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    base = F.substring_index(F.regexp_replace(inner, r"/+$", ""), "/", -1)
    name = F.coalesce(F.try_url_decode(F.replace(base, F.lit("+"), F.lit("%2B"))), base)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    clean = F.regexp_replace(strip(F.regexp_replace(stem, r"[_\-]+", " ")), r"(?U)\s+", " ")
    return F.when(clean != "", clean)


def snippet(t: Column, at: Column, length: Column, margin: int = 40) -> Column:
    """The text around a hit at 1-based place ``at``, stripped."""
    first = F.greatest(F.lit(1), at - margin)
    return strip(F.substring(t, first, at + length + margin - first))


def highlight(t: Column, phrase: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Every occurrence of a literal phrase marked, ignoring case; a blank
    phrase leaves the text alone."""
    if not phrase.strip():
        return t
    return F.regexp_replace(t, "(?iu)(" + quoted_pattern(phrase) + ")", f"{before}$1{after}")


def md5_bucket(token: Column, size: int) -> Column:
    """The md5 of a token as a 128-bit number, modulo ``size``."""
    digest, rest = F.md5(token.cast("binary")), F.lit(0).cast("long")
    # where the size divides 2**32, the last eight digits decide
    for k in range(3 if (1 << 32) % size == 0 else 0, 4):
        part = F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
        rest = (rest * ((1 << 32) % size) + part) % size
    return rest.cast("int")


def sniff_mime(content: Column) -> Column:
    """File type by first bytes, or null."""
    start, out = F.hex(F.substring(content, 1, 8)), F.lit(None).cast("string")
    for kind, first in reversed(SIGNATURES):
        out = F.when(start.startswith(first), F.lit(kind)).otherwise(out)
    return out


def lenient_json(t: Column) -> Column:
    """The text if it is JSON, else its part from the first { to the last } if
    that is, else null."""
    whole = strip(t)
    inner = F.regexp_extract(whole, r"(?s)\{.*\}", 0)
    ok = lambda c: F.try_parse_json(c).isNotNull()
    return F.when((whole != "") & ok(whole), whole).when((inner != "") & ok(inner), inner)


#: Named character references that links and plain markup use.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}


def decode_references(text: Column) -> Column:
    """Character references by number, and the named ones of ``NAMED``, decoded
    once; others stay."""

    def by_number(p: Column, code: Column) -> Column:
        fits = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(fits, F.concat(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"), F.regexp_replace(p, r"^[^;]*;", ""))).otherwise(F.concat(F.lit("&"), p))

    def one(p: Column) -> Column:
        """A part that came after an ampersand."""
        ten = let(F.regexp_extract(p, r"^#([0-9]{1,7});", 1).try_cast("int"), lambda c: by_number(p, c))
        sixteen = let(F.conv(F.regexp_extract(p, r"^#[xX]([0-9a-fA-F]{1,6});", 1), 16, 10).try_cast("int"), lambda c: by_number(p, c))
        out = F.when(p.rlike(r"^#[0-9]"), ten).when(p.rlike(r"^#[xX]"), sixteen)
        for name, c in NAMED.items():
            out = out.when(p.startswith(name + ";"), F.concat(F.lit(c), F.substring(p, len(name) + 2, 1 << 30)))
        return out.otherwise(F.concat(F.lit("&"), p))

    def whole(parts: Column) -> Column:
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), ""))

    return F.when(F.contains(text, F.lit("&")), let(F.split(text, "&"), whole)).otherwise(text)
