"""URL functions as Column expressions, by the pattern of RFC 3986, appendix B."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"

#: First and last address of the ranges that are not public, of
#: those inside them that are, and (first bits) of the address ranges of version 6.
PRIVATE = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"), ("224.0.0.0", "255.255.255.255"),
)
PUBLIC = (("192.0.0.9", "192.0.0.10"),)
PRIVATE_6 = "::/8 100::/8 200::/7 400::/6 800::/5 1000::/4 2001::/23 2001:db8::/32 2002::/16 3fff::/20 4000::/3 6000::/3 8000::/3 a000::/3 c000::/3 e000::/4 f000::/5 f800::/6 fc00::/7 fe00::/9 fe80::/10 fec0::/10 ff00::/8".split()
PUBLIC_6 = "2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28".split()


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, "(?s)" + PARTS, k)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), r"^.*@", ""), r":[0-9]*$", ""))


def path(url: Column) -> Column:
    return part(url, 3)


def normalize_url(url: Column) -> Column:
    """Scheme and authority in lower case, no fragment, no slashes at the end of
    a longer path; an empty path becomes /."""

    def whole(u: Column) -> Column:
        p = let(path(u), lambda x: F.when(x.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(x, r"/+$", "")))
        before = lambda mark, c: let(c, lambda x: F.when(x != "", F.concat(F.lit(mark), x)).otherwise(""))
        s = let(scheme(u), lambda x: F.when(x != "", F.concat(x, F.lit(":"))).otherwise(""))
        return F.concat(s, before("//", F.lower(part(u, 2))), p, before("?", part(u, 4)))

    return let(url, whole)


def resolve(base: Column, href: Column) -> Column:
    """The address that a link on a page leads to (RFC 3986, 5.2; segments of
    dots that lead above the root are dropped)."""
    root, folder = F.concat(scheme(base), F.lit("://"), part(base, 2)), F.split(path(base), "/")
    bare, own = F.regexp_replace(base, r"#.*$", ""), F.lower(F.regexp_extract(href, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))

    def joined(rel: Column) -> Column:
        """A link with a path: its segments after those of the page's folder."""
        p = F.regexp_extract(rel, r"^[^?#]*", 0)

        def beside(given: Column, up: Column) -> Column:
            above = F.when(F.element_at(up, -1) != "", F.slice(up, 1, F.size(up) - 1)).otherwise(up)
            every = lambda a: F.concat(F.slice(a, 1, 1), F.filter(F.slice(a, 2, F.size(a) - 2), lambda x: x != ""), F.slice(a, F.size(a), 1))
            return F.when(p.startswith("/"), given).otherwise(let(F.concat(above, given), every))

        def without_dots(given: Column) -> Column:
            up = lambda done: F.when(F.size(done) > 0, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
            step = lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
            left = F.aggregate(given, F.array().cast("array<string>"), step)
            return F.concat(left, F.when(F.element_at(given, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))

        def text(segments: Column) -> Column:
            line = F.array_join(segments, "/")
            return F.when(line.startswith("/"), line).otherwise(F.concat(F.lit("/"), line))

        segments = let(F.split(p, "/"), lambda given: let(folder, lambda up: beside(given, up)))
        flat = let(segments, lambda given: F.when(F.exists(given, lambda x: x.isin(".", "..")), without_dots(given)).otherwise(given))
        return F.concat(root, let(flat, text), F.regexp_extract(rel, r"^[^?#]*(.*)$".replace("^", "(?s)^", 1), 1))

    same = (own != "") & (own == scheme(base)) & ~href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://")
    whole = let(
        F.when(same, F.regexp_replace(href, r"^[^:]*:", "")).otherwise(href),
        lambda rel: F.when(rel == "", base)
        .when(rel.startswith("//"), F.concat(scheme(base), F.lit(":"), rel))
        .when(rel.startswith("#"), F.concat(bare, rel))
        .when(rel.startswith("?"), F.concat(root, path(base), rel))
        .otherwise(joined(rel)),
    )
    return F.when((own != "") & ~same, href).otherwise(whole)


def host_allowed(h: Column, domains: list[str]) -> Column:
    """The host is an allowed domain or under one; no domains allow every host."""
    wanted = [d.lower().strip() for d in domains if d.strip()]
    if not domains:
        return F.lit(True)
    return F.exists(F.array(*map(F.lit, wanted)), lambda d: (h == d) | h.endswith(F.concat(F.lit("."), d))) if wanted else F.lit(False)


def address(h: Column) -> Column:
    """A dotted address as a number, or null."""
    n = F.lit(0).cast("long")
    for k in range(1, 5):
        n = n * 256 + F.regexp_extract(h, r"^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})$", k).try_cast("long")
    return n


def bits_6(h: Column) -> Column:
    """The 128 bits of an address of version 6 in brackets, as text, or null."""
    none = F.array().cast("array<string>")

    def grouped(inner: Column) -> Column:
        """An address of version 4 at the end as two groups."""
        old = F.regexp_extract(inner, r"([0-9]{1,3}\.[0-9.]+)$", 1)
        group = lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))
        two = let(address(old), lambda n: F.concat(F.regexp_replace(inner, r"[0-9]{1,3}\.[0-9.]+$", ""), group(F.floor(n / 65536)), F.lit(":"), group(n % 65536)))
        return F.when(old == "", inner).otherwise(two)

    def groups(plain: Column) -> Column:
        """Eight groups, with zeros where :: stands."""
        side = lambda k: F.coalesce(F.filter(F.split(F.get(F.split(plain, "::"), F.lit(k)), ":"), lambda x: x != ""), none)
        short = lambda a, b: F.contains(plain, F.lit("::")) & (F.size(a) + F.size(b) < 8)
        return let(side(0), lambda a: let(side(1), lambda b: F.when(short(a, b), F.concat(a, F.array_repeat(F.lit("0"), 8 - F.size(a) - F.size(b)), b)).otherwise(F.concat(a, b))))

    def bits(whole: Column) -> Column:
        fits = (F.size(whole) == 8) & F.forall(whole, lambda x: F.length(x) <= 4)
        return F.when(fits, F.array_join(F.transform(whole, lambda x: F.lpad(F.conv(x, 16, 2), 16, "0")), ""))

    inner = F.regexp_extract(h, r"^\[([0-9a-fA-F:]+(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3})?)(?:%[^\]]*)?\]$", 1)
    return F.when(h.startswith("["), let(let(inner, grouped), lambda plain: F.when(plain != "", let(groups(plain), bits))))


def prefixes_6(ranges: list[str]) -> Column:
    from ipaddress import IPv6Network

    return F.array(*[F.lit(f"{int(net.network_address):0128b}"[: net.prefixlen]) for net in map(IPv6Network, ranges)])


def is_private(h: Column) -> Column:
    """The host is written as an address that is not public (an address of
    version 4 inside one of version 6 counts as the latter)."""

    def number(text: str) -> int:
        a, b, c, d = map(int, text.split("."))
        return ((a * 256 + b) * 256 + c) * 256 + d

    def inside(n: Column, ranges) -> Column:
        return reduce(or_, [n.between(number(low), number(high)) for low, high in ranges])

    def six(bits: Column) -> Column:
        among = lambda ranges: F.exists(prefixes_6(ranges), lambda p: bits.startswith(p))
        return among(PRIVATE_6) & ~among(PUBLIC_6)

    four = let(address(h), lambda n: inside(n, PRIVATE) & ~inside(n, PUBLIC))
    return F.coalesce(F.when(h == "localhost", True).when(h.startswith("["), let(bits_6(h), six)).otherwise(four), F.lit(False))


def is_document(url: Column, extensions: list[str]) -> Column:
    p, ok = F.lower(path(url)), F.lit(False)
    for e in extensions:
        ok = ok | p.endswith(e)
    return ok


def scope(url: Column, domains: list[str]) -> Column:
    """Why a URL may not be fetched, or null: scheme, host, domain, address."""

    def why(u: Column) -> Column:
        bad = F.when(~F.coalesce(scheme(u).isin("http", "https"), F.lit(False)), F.lit("scheme not allowed"))
        return bad.otherwise(
            let(
                host(u),
                lambda h: F.when(h == "", F.lit("no host")).when(~host_allowed(h, domains), F.lit("host not in allowed domains")).when(is_private(h), F.lit("address not public")),
            )
        )

    return F.coalesce(let(url, why), F.when(url.isNull(), F.lit("scheme not allowed")))
