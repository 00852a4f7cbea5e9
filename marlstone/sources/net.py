"""Fetching addresses: which may be asked, how redirects, sizes and charsets are handled."""

from __future__ import annotations

import codecs
import http.client
import ipaddress
import re
import socket
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.errors import InvalidInput, MarlstoneError, NetworkError

MAX_BODY = 10 * 1024 * 1024
MAX_REDIRECTS = 10
TIMEOUT = 30.0
QUOTED = 512

# IPv4 blocks that are not public, and IPv6 space that is handed out, with exceptions.
PRIVATE_V4 = [
    ipaddress.ip_network(n)
    for n in """0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16
    198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4""".split()
]
GLOBAL_V6 = ipaddress.ip_network("2000::/3")
PRIVATE_V6 = [ipaddress.ip_network(n) for n in "2001::/23 2001:db8::/32 2002::/16 3ffe::/16 3fff::/20 5f00::/16".split()]
PUBLIC_V6 = [ipaddress.ip_network(n) for n in "2001:1::1/128 2001:1::2/128 2001:1::3/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28".split()]


def is_public_ip(address: str) -> bool:
    """Whether an address may be asked. What is no address is not public."""
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return False
    if ip.version == 4:
        return not any(ip in n for n in PRIVATE_V4)
    if ip.ipv4_mapped is not None:
        return is_public_ip(str(ip.ipv4_mapped))
    return ip in GLOBAL_V6 and (any(ip in n for n in PUBLIC_V6) or not any(ip in n for n in PRIVATE_V6))


def check_destination(url: str, allow_private: bool = False) -> None:
    """InvalidInput for what is no address, NetworkError for other schemes and hosts of which any address is not public."""
    try:
        parts = urlsplit(url)
        port = parts.port
    except ValueError as e:
        raise InvalidInput(f"invalid URL '{url}': {e}") from None
    if parts.scheme not in ("http", "https"):
        raise NetworkError(f"unsupported URL scheme '{parts.scheme}'; expected http or https")
    host = (parts.hostname or "").rstrip(".")
    if not host:
        raise NetworkError("URL has no host")
    if allow_private:
        return
    if host == "localhost" or host.endswith(".localhost"):
        raise NetworkError(f"destination '{host}' is not allowed")
    try:
        found = socket.getaddrinfo(host, port or (443 if parts.scheme == "https" else 80), type=socket.SOCK_STREAM)
    except OSError as e:
        raise NetworkError(f"could not resolve '{host}': {e}") from None
    for *_, address in found:
        if not is_public_ip(address[0].split("%")[0]):
            raise NetworkError(f"destination '{host}' resolves to non-public address {address[0]}")


def decode(body: bytes, content_type: str | None) -> str:
    """By the charset of the content type, as browsers read its names; UTF-8 if there is none or it is unknown. A byte order
    mark at the beginning says more than the name."""
    for mark, code in ((b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le")):
        if body.startswith(mark):
            return body[len(mark) :].decode(code, "replace")
    m = re.search(r";\s*charset\s*=\s*[\"']?([^\"';]*)", content_type or "", re.I)
    name = m.group(1).strip().lower() if m else "utf-8"
    for code, names in WEB_LABELS.items():
        if name in names:
            name = code
    try:
        text = body.decode(name, "replace") if name not in NOT_OF_THE_WEB else body.decode("utf-8", "replace")
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")
    if name == "cp1252":  # the five bytes without a character stand for controls
        return body.decode("cp1252", "controls")
    return text


def _controls(error: UnicodeDecodeError) -> tuple[str, int]:
    return "".join(chr(b) for b in error.object[error.start : error.end]), error.end


codecs.register_error("controls", _controls)


def truncated(text: str) -> str:
    return text if len(text) <= QUOTED else text[:QUOTED] + "… (truncated)"


# Names of charsets that browsers read as another than Python does.
WEB_LABELS = {
    "cp1252": frozenset("latin1 latin-1 iso-8859-1 iso8859-1 iso_8859-1 l1 ascii us-ascii ansi_x3.4-1968 cp1252 windows-1252 x-cp1252 cp819 ibm819 iso88591".split()),
    "cp1254": frozenset("iso-8859-9 iso8859-9 iso_8859-9 latin5 l5 windows-1254 cp1254".split()),
    "cp874": frozenset("iso-8859-11 iso8859-11 tis-620 dos-874 windows-874".split()),
    "gb18030": frozenset("gb2312 gbk x-gbk chinese gb_2312 gb_2312-80".split()),
    "cp932": frozenset("shift_jis shift-jis sjis ms_kanji x-sjis windows-31j ms932".split()),
    "cp949": frozenset("euc-kr ks_c_5601-1987 korean windows-949".split()),
    "utf-16-le": frozenset("utf-16 utf-16le unicode ucs-2".split()),
}
#: Codecs of Python that are no charsets of the web.
NOT_OF_THE_WEB = frozenset("utf-7 utf_7 idna punycode unicode_escape raw_unicode_escape rot13 hex base64 zip bz2 uu quopri utf-32 utf_32 cp037 cp500 mbcs oem undefined".split())


@dataclass
class Fetched:
    final_url: str
    content_type: str | None
    body: str


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def fetch(url: str, allow_private: bool = False, limit: int = MAX_BODY, timeout: float = TIMEOUT) -> Fetched:
    """Every hop is checked before it is asked."""
    opener = urllib.request.build_opener(_NoRedirect)
    for _ in range(MAX_REDIRECTS + 1):
        check_destination(url, allow_private)
        try:
            response = opener.open(urllib.request.Request(url, headers={"User-Agent": "marlstone"}), timeout=timeout)
        except urllib.error.HTTPError as e:
            if e.code in (301, 302, 303, 307, 308) and e.headers.get("Location"):
                url = urljoin(url, e.headers["Location"])
                continue
            raise NetworkError(f"fetching '{url}' returned HTTP {e.code}") from None
        except (OSError, ValueError, http.client.HTTPException) as e:
            raise NetworkError(f"request to '{url}' failed: {e}") from None
        with response:
            too_large = f"response from '{url}' exceeded the {limit}-byte limit"
            declared = response.headers.get("Content-Length") or ""
            if declared.isdigit() and int(declared) > limit:
                raise NetworkError(too_large)
            try:
                body = response.read(limit + 1)
            except (OSError, ValueError, http.client.HTTPException) as e:
                raise NetworkError(f"reading body of '{url}' failed: {e}") from None
            if len(body) > limit:
                raise NetworkError(too_large)
            kind = response.headers.get("Content-Type")
            return Fetched(url, kind, decode(body, kind))
    raise NetworkError(f"too many redirects (more than {MAX_REDIRECTS})")


def fetch_table(frame: DataFrame, url: str, allow_private: bool = False, limit: int = MAX_BODY, timeout: float = TIMEOUT) -> DataFrame:
    """Adds fetched struct(final_url, content_type, body, error). Failures are data; null addresses stay null."""

    @F.pandas_udf("final_url string, content_type string, body string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            rows = []
            for u in urls:
                try:
                    f = fetch(u, allow_private, limit, timeout) if u is not None else Fetched(None, None, None)
                    rows.append((f.final_url, f.content_type, f.body, None))
                except MarlstoneError as e:
                    rows.append((None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["final_url", "content_type", "body", "error"])

    return frame.withColumn("fetched", run(F.col(url)))
