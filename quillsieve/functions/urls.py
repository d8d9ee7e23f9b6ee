"""URLs and names made of them: validation, redaction, internal hosts, encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The longest URL, schemes that are refused by name, local host names, and parts of parameter names whose values are secret.
MAX_URL = 2048
REFUSED = ("javascript:", "data:", "vbscript:")
LOCAL_NAMES = ("localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback")
SECRET_PARTS = ("token", "secret", "key", "password", "auth")
# Ranges of IPv4 that are internal, as (first octet, least and greatest second octet).
INTERNAL = ((127, 0, 255), (10, 0, 255), (172, 16, 31), (192, 168, 168), (169, 254, 254), (100, 64, 127), (198, 18, 19))


def valid_url(url: Column) -> Column:
    """The URL in its normal form: https where no scheme is given, no slash at its end; null if it is none or refused."""
    cut = F.trim(F.regexp_replace(url, r"^\s+|\s+\z", ""))
    low = F.lower(cut)
    refused = F.lit(False)
    for scheme in REFUSED:
        refused = refused | F.startswith(low, F.lit(scheme))
    whole = F.when(cut.rlike("^https?://"), cut).otherwise(F.concat(F.lit("https://"), cut))
    host = F.regexp_extract(whole, r"^https?://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:@\s\[\]]+)(?::[0-9]{0,5})?(?:[/?#].*)?\z", 1)
    good = (F.octet_length(url) <= MAX_URL) & ~refused & (cut != "") & (host != "")
    return F.when(good, F.regexp_replace(whole, r"/+\z", ""))


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without brackets and port; empty if there is none."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1), r"^\[|\]$", ""))


def _internal_v4(host: Column) -> Column:
    parts = F.transform(F.split(host, r"\."), lambda p: p.try_cast("int"))
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    inside = (host == "0.0.0.0") | (host == "255.255.255.255") | a.between(224, 239)
    for first, low, high in INTERNAL:
        inside = inside | ((a == first) & b.between(low, high))
    whole = host.rlike(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}\z") & F.forall(parts, lambda p: p <= 255)
    return F.coalesce(whole & inside, F.lit(False))


def is_internal_host(host: Column) -> Column:
    """Whether a host (lower case, no brackets) is a local name or an address of an internal, local or multicast range."""
    six = F.contains(host, F.lit(":"))
    mapped = F.regexp_extract(host, r"^::ffff:([0-9.]+)\z", 1)
    first = F.conv(F.lpad(F.regexp_extract(host, "^([0-9a-f]{1,4}):", 1), 4, "0"), 16, 10).cast("int")
    unique, link, many = first.between(0xFC00, 0xFDFF), first.between(0xFE80, 0xFEBF), first.between(0xFF00, 0xFFFF)
    zero = host.rlike(r"^(?:0{0,4}:){2,7}(?:0{0,4}|0{0,3}1)\z")
    inside = zero | F.coalesce(unique | link | many, F.lit(False)) | ((mapped != "") & _internal_v4(mapped))
    return host.isin(*LOCAL_NAMES) | F.when(six, inside).otherwise(_internal_v4(host))


def redacted_url(url: Column) -> Column:
    """The URL without user and password, values of secret parameters replaced; what is no URL loses all after its question mark."""
    bare = F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1")
    head, tail = F.substring_index(bare, "?", 1), F.regexp_extract(bare, r"\?([^#]*)", 1)
    mark = F.regexp_extract(bare, r"(#.*)\z", 1)

    def one(pair):
        name = F.lower(F.substring_index(pair, "=", 1))
        hidden = name == "code"
        for part in SECRET_PARTS:
            hidden = hidden | F.contains(name, F.lit(part))
        return F.when(hidden, F.concat(F.substring_index(pair, "=", 1), F.lit("=%5BREDACTED%5D"))).when(~F.contains(pair, F.lit("=")), F.concat(pair, F.lit("="))).otherwise(pair)

    query = F.array_join(F.transform(F.filter(F.split(tail, "&"), lambda p: p != ""), one), "&")
    parsed = F.concat(head, F.when(F.contains(bare, F.lit("?")), F.concat(F.lit("?"), query)).otherwise(""), mark)
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]"), parsed).otherwise(F.substring_index(url, "?", 1))


def encoded_path(path: Column) -> Column:
    """Percent-encoded path: letters, digits, - _ . ~ and the slashes stay."""
    code = F.regexp_replace(F.regexp_replace(F.url_encode(path), r"\+", "%20"), r"\*", "%2A")
    return F.replace(F.replace(code, F.lit("%7E"), F.lit("~")), F.lit("%2F"), F.lit("/"))


def encoded_query(value: Column) -> Column:
    """A form-encoded value: a blank is a plus."""
    return F.url_encode(value)


def target_name(url: Column) -> Column:
    """A file name for a target: its URL without scheme, all but letters, digits, - and . as _, at most 200 characters."""
    bare = F.regexp_replace(F.regexp_replace(url, "^(?:https://)+", ""), "^(?:http://)+", "")
    return F.left(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}.-]", "_"), r"^_+|_+\z", ""), F.lit(200))


def directory_name(path: Column) -> Column:
    """A file name for a directory: that of its last part."""
    last = F.regexp_extract(path, r"([^/]+)/*\z", 1)
    return target_name(F.when(F.trim(last).isin("", "."), F.lit("directory_scan")).otherwise(last))


def workspace_name(full_name: Column) -> Column:
    return F.replace(full_name, F.lit("/"), F.lit("_"))


def object_path(sha1: Column) -> Column:
    """Where a loose object lies."""
    return F.when(F.length(sha1) < 2, F.concat(F.lit("objects/"), sha1)).otherwise(F.concat(F.lit("objects/"), F.left(sha1, F.lit(2)), F.lit("/"), F.substring(sha1, 3, 1 << 20)))
