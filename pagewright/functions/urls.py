"""URL functions on columns: normal form, identity keys, kind, site and scope tests. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import bound

# Query keys that track visitors and never change a page.
TRACKING = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id gclid fbclid msclkid mc_cid mc_eid igshid ref ref_src "
    "_ga _gl yclid dclid twclid s_kwcid hsa_acc hsa_cam"
).split()
# Suffixes of images, and of other files that are no pages.
IMAGES = "jpg jpeg png gif webp avif svg ico bmp tiff".split()
FILES = (
    "css js mjs map json xml rss atom zip gz tar rar 7z dmg exe pkg deb rpm mp3 mp4 avi mov wmv webm ogg wav m4a "
    "woff woff2 ttf otf eot doc docx xls xlsx ppt pptx"
).split()
# Schemes and forms that are no addresses of pages.
NO_ADDRESS = r"^(#|javascript:|mailto:|tel:|data:|blob:)"
HOLE = r"/(undefined|null|NaN|\[object Object\])(/|$)"
DATE_END = r"/(date/.*|(19|20)\d{2}/(0[1-9]|1[0-2])(/(0[1-9]|[12]\d|3[01]))?)$"

ABSOLUTE = r"^(?i)(https?)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, ABSOLUTE, group)


def host(url: Column) -> Column:
    """Lower-case host name, '' if the url is not absolute."""
    return F.lower(_part(url, 2))


def site_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return _part(url, 4)


def suffix(url: Column) -> Column:
    """Lower-case extension of the last path segment, '' if it has none."""
    return F.lower(F.regexp_extract(F.regexp_extract(path(url), r"([^/]*)$", 1), r"\.([^.]*)$", 1))


def _query(raw: Column) -> Column:
    decoded = lambda s: F.coalesce(F.try_url_decode(s), s)
    encoded = lambda s: F.replace(F.replace(F.url_encode(s), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pairs = F.filter(F.split(raw, "&"), lambda p: p != "")
    parts = F.transform(pairs, lambda p: F.named_struct(F.lit("k"), decoded(F.regexp_extract(p, "^([^=]*)", 1)), F.lit("v"), decoded(F.regexp_extract(p, "^[^=]*=?(.*)$", 1))))
    kept = F.array_sort(F.filter(parts, lambda p: ~F.lower(p["k"]).isin(*TRACKING)))
    return F.array_join(F.transform(kept, lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")


def normalize_url(url: Column) -> Column:
    """Normal form of an absolute http(s) address of a page, else null.

    Lower-case scheme and host, no default port, index file, tracking keys or fragment; query sorted and encoded anew. The
    trailing slash stays.
    """

    def normal(u):
        scheme, name, port, way = F.lower(u["scheme"]), F.lower(u["host"]), u["port"], u["path"]
        bare = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
        end = F.when(u["query"] == "", "").otherwise(F.concat(F.lit("?"), u["query"]))
        full = F.concat(scheme, F.lit("://"), name, F.when(bare, "").otherwise(F.concat(F.lit(":"), port)), u["route"], end)
        last = F.lower(F.regexp_extract(F.regexp_extract(u["route"], r"([^/]*)$", 1), r"\.([^.]*)$", 1))
        fine = url.rlike(ABSOLUTE) & ~url.rlike(NO_ADDRESS) & (name != "") & ~way.rlike(HOLE) & ~last.isin(*IMAGES, *FILES)
        return F.when(fine, full)

    route = F.regexp_replace(path(url), r"(?i)/index\.(html?|php|aspx?)$", "/")
    route = F.when(route == "", "/").otherwise(route)
    parts = F.struct(_part(url, 1).alias("scheme"), _part(url, 2).alias("host"), _part(url, 3).alias("port"), path(url).alias("path"), route.alias("route"), _query(_part(url, 5)).alias("query"))
    return bound(parts, normal)


def canonical_key(url: Column) -> Column:
    """Identity of a page: normal form without www. and trailing slashes (scheme kept); the url itself if it has none."""

    def key(n):
        rest = F.regexp_replace(F.regexp_extract(n, r"^[^?]*", 0), r"^(https?://)(www\.)?", "$1")
        rest = F.regexp_replace(rest, r"^(https?://[^/]*?)(/.*?)?/*$", "$1$2")
        rest = F.when(rest.rlike(r"^https?://[^/]*$"), F.concat(rest, F.lit("/"))).otherwise(rest)
        return F.concat(rest, F.regexp_extract(n, r"\?.*$", 0))

    return F.coalesce(bound(normalize_url(url), key), url)


def page_key(url: Column) -> Column:
    """Identity of a page in the site graph: canonical_key without the scheme."""
    return F.regexp_replace(canonical_key(url), r"^https?://", "")


def url_kind(url: Column) -> Column:
    """page, pdf, image, other_file, archive, category or tag, from the address alone."""
    p, ext = F.lower(path(url)), suffix(url)
    kind = F.regexp_extract(p, r"/(categor(?:y|ies)|tags?)/[^/]", 1)
    return (
        F.when(ext == "pdf", "pdf")
        .when(ext.isin(*IMAGES), "image")
        .when(ext.isin(*FILES), "other_file")
        .when(F.regexp_replace(p, "/+$", "").rlike(DATE_END), "archive")
        .when(kind.startswith("categor"), "category")
        .when(kind != "", "tag")
        .otherwise("page")
    )


def same_site(url: Column, root: Column, subdomains: bool = False) -> Column:
    a, b = site_host(url), site_host(root)
    equal = (a == b) & (a != "")
    return equal | a.endswith(F.concat(F.lit("."), b)) if subdomains else equal


def reconcile_scheme(url: Column, root: Column) -> Column:
    """The url with the root's scheme where the hosts are equal."""
    return F.when(host(url) == host(root), F.concat(F.lower(_part(root, 1)), F.regexp_replace(url, r"(?i)^https?", ""))).otherwise(url)


def section_of(url: Column) -> Column:
    return F.regexp_extract(path(url), r"^/+([^/]+)", 1)


def registrable(h: Column) -> Column:
    """Registered domain: the last two labels, three under second-level registries such as co.uk."""
    second = h.rlike(r"\.(co|com|net|org|gov|ac|edu|ne|or|go)\.[a-z]{2}$")
    labels = F.split(h, r"\.")
    return F.array_join(F.slice(labels, -F.least(F.size(labels), F.when(second, 3).otherwise(2)), F.when(second, 3).otherwise(2)), ".")


def scope_refusal(url: Column, depth: Column, root: Column, max_depth: int, include: list[str] = (), exclude: list[str] = (), subdomains: bool = False) -> Column:
    """First reason for leaving an address out (past-depth, off-site, excluded, not-included), null if it is in scope."""
    hit = lambda patterns: F.lit(False) if not patterns else F.coalesce(url.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))
    out = F.when(depth > max_depth, "past-depth").when(~same_site(url, root, subdomains), "off-site").when(hit(exclude), "excluded")
    return out.when(~hit(include), "not-included") if include else out


def same_page(a: Column, b: Column) -> Column:
    """Same host but for www., same path but for the trailing slash, same query; the scheme does not matter."""
    strip = lambda u: F.regexp_replace(path(u), "/+$", "")
    return (site_host(a) == site_host(b)) & (strip(a) == strip(b)) & (_part(a, 5) == _part(b, 5))


# Path segments of login pages.
LOGIN = "login login.php login.aspx signin sign-in sign_in sso auth authenticate oauth oauth2 authorize session/new sessions/new wp-login.php".split()


def is_login_path(url: Column) -> Column:
    segments = "|".join(s.replace(".", r"\.") for s in LOGIN)
    return F.lower(path(url)).rlike(rf"/({segments})(/|$)")


def robots_pattern(pattern: Column) -> Column:
    """A regular expression for a robots.txt path pattern: * is any run, a final $ the end."""
    quoted = F.regexp_replace(pattern, r"([\\.\[\]{}()+?^|])", r"\\$1")
    starred = F.replace(quoted, F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("^"), F.regexp_replace(starred, r"\$(?!$)", r"\\\$"))


def page_url(root: Column, relative: Column) -> Column:
    """The address of a file below a root; index files are their folder."""
    return F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), F.regexp_replace(F.regexp_replace(relative, "^/+", ""), r"(^|/)index\.html?$", "$1"))


def ancestor_path(xpath: Column, tag: str) -> Column:
    """The XPath up to the innermost element of a tag; null if there is none."""
    return F.nullif(F.regexp_extract(xpath, rf"^(.*/{tag}\[\d+\])(?:/|$)", 1), F.lit(""))
