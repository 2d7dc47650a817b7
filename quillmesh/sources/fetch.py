"""Fetching pages: which addresses may be asked, redirects followed by hand, bytes capped; and PDFs page by page."""

from __future__ import annotations

import io
import ipaddress
import socket
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import garbled_share, text_verdict, visible_text
from quillmesh.operators.planning import page_label
from quillmesh.sources.store import PAGE_BYTES, PDF_BYTES, PDF_MAGIC

# Schemes and ports that may be asked, networks that may not, hops, seconds; pages, seconds and shares of PDFs.
SCHEMES, PORTS = ("http", "https"), (None, 80, 443)
BLOCKED = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/4", "255.255.255.255/32",
    "::/128", "::1/128", "::ffff:0:0/96", "64:ff9b::/96", "100::/64", "fc00::/7", "fe80::/10",
)
REDIRECTS, SECONDS = 5, 15
PDF_PAGES, PDF_SECONDS, PAGE_CHARS, GARBLED = 40, 60.0, 20, 0.10
_NETS = [ipaddress.ip_network(n) for n in BLOCKED]


def blocked(address: str) -> bool:
    """Whether an IP address is private, reserved or otherwise not to be asked; mapped ones count as what they map."""
    a = ipaddress.ip_address(address.split("%")[0])
    a = getattr(a, "ipv4_mapped", None) or a
    return any(a.version == n.version and a in n for n in _NETS) or a.is_private or a.is_loopback or a.is_link_local or a.is_multicast or a.is_reserved or a.is_unspecified


def resolve(host: str) -> list[str]:
    return [x[4][0] for x in socket.getaddrinfo(host, None, type=socket.SOCK_STREAM)]


def refusal(url: str, resolver: Callable[[str], list[str]] = resolve, ports: tuple = PORTS) -> str | None:
    """Why an address is not to be asked, or None: its scheme, user, port, host, or any address that its host resolves to."""
    try:
        u = urlsplit(url)
        port = u.port
    except ValueError:
        return "url is malformed"
    if u.scheme.lower() not in SCHEMES:
        return f"scheme not allowed: {u.scheme}"
    if u.username is not None or u.password is not None:
        return "userinfo not allowed"
    if port not in ports:
        return f"port not allowed: {port}"
    if not u.hostname:
        return "no host"
    try:
        found = resolver(u.hostname)
    except OSError:
        found = []
    if not found:
        return "host did not resolve"
    return "private or reserved address" if any(blocked(a) for a in found) else None


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def ask(url: str) -> tuple[int, dict, bytes]:
    """(status, headers, body) of one request without redirects, of a byte more than may be read at most."""
    request = urllib.request.Request(url, headers={"User-Agent": "quillmesh"})
    try:
        with urllib.request.build_opener(_Stay).open(request, timeout=SECONDS) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read(PDF_BYTES + 1)
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, b""


def get(url: str, asker=ask, resolver=resolve) -> tuple[bytes, str, str | None]:
    """(body, content type, error): each hop is checked before it is asked; pages are cut, too large PDFs refused."""
    for _ in range(REDIRECTS + 1):
        if why := refusal(url, resolver):
            return b"", "", why
        try:
            status, headers, body = asker(url)
        except OSError as e:
            return b"", "", f"http_error: {type(e).__name__}"
        if status in (301, 302, 303, 307, 308):
            if not headers.get("location"):
                return b"", "", "redirect without a location"
            url = urljoin(url, headers["location"])
            continue
        if status >= 400:
            return b"", "", f"http_error: {status}"
        kind = headers.get("content-type", "")
        if "application/pdf" in kind.lower() or body[:1024].lstrip().startswith(PDF_MAGIC.encode()):
            return (body, "application/pdf", None) if len(body) <= PDF_BYTES else (b"", "application/pdf", "pdf_too_large")
        return body[:PAGE_BYTES], kind, None
    return b"", "", "too many redirects"


def fetch(urls: DataFrame, url: str = "url", asker=ask, resolver=resolve) -> DataFrame:
    """urls with body, content_type and error; an Arrow batch at a time, on the executors."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [get(u, asker, resolver) if isinstance(u, str) else (b"", "", "url is malformed") for u in b[url]]
            yield b.assign(body=[g[0] for g in got], content_type=[g[1] for g in got], error=[g[2] for g in got])

    return urls.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in urls.dtypes) + ", body binary, content_type string, error string")


def by_pypdf(data: bytes) -> Iterator[str | Exception]:
    """The text of each page; a page that cannot be read is its error. Needs pypdf, which is optional."""
    from pypdf import PdfReader

    reader = PdfReader(io.BytesIO(data))
    if reader.is_encrypted and not reader.decrypt(""):
        raise PermissionError("pdf_encrypted")
    for i in range(len(reader.pages)):
        try:
            yield reader.pages[i].extract_text() or ""
        except Exception as e:  # noqa: BLE001 - one bad page must not lose the others
            yield e


PAGES = "total int, pages array<struct<page:int,text:string>>, unreadable array<int>, capped boolean, late boolean, error string"


def pdf_pages(files: DataFrame, by: list[str], reader=by_pypdf, pages: int = PDF_PAGES, seconds: float = PDF_SECONDS) -> DataFrame:
    """(by, total, pages, unreadable, capped, late, error) of files (by, content): pages in order, as many and as long as allowed."""
    kinds = dict(files.dtypes)

    def one(data: bytes) -> tuple:
        began, total, out, bad, late = time.monotonic(), 0, [], [], False
        try:
            for n, text in enumerate(reader(data), 1):
                total = n
                if n > pages or late:
                    continue
                if time.monotonic() - began >= seconds:
                    late = True
                    continue
                if isinstance(text, Exception):
                    bad.append(n)
                else:
                    out.append({"page": n, "text": text})
        except PermissionError:
            return 0, [], [], False, False, "pdf_encrypted"
        except Exception as e:  # noqa: BLE001 - any parser may fail on untrusted bytes
            return 0, [], [], False, False, f"pdf_unreadable: {type(e).__name__}"
        return total, out, bad, total > pages, late, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(x or b"") for x in b["content"]]
            yield b[by].assign(**{n: [g[i] for g in got] for i, n in enumerate(("total", "pages", "unreadable", "capped", "late", "error"))})

    return files.select(*by, "content").mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + f", {PAGES}")


def pdf_result(read: DataFrame) -> DataFrame:
    """What pdf_pages gives, with kept pages, markdown (pages after their marks), warnings, and verdict: why there is nothing to use, or null."""
    clean = F.transform("pages", lambda p: F.struct(p["page"].alias("page"), F.regexp_replace(F.regexp_replace(F.regexp_replace(p["text"], r"(?m)^[ \t]+|[ \t]+$", ""), r"[ \t]{2,}", " "), r"\n{3,}", "\n\n").alias("text")))
    told = read.withColumn("_all", clean).withColumn("kept", F.filter("_all", lambda p: F.length(visible_text(p["text"])) >= PAGE_CHARS))
    blank = F.transform(F.filter("_all", lambda p: F.length(visible_text(p["text"])) < PAGE_CHARS), lambda p: p["page"])
    bad = F.transform(F.filter("kept", lambda p: garbled_share(p["text"]) >= GARBLED), lambda p: p["page"])
    told = told.withColumn("_blank", blank).withColumn("_bad", bad)
    warn = F.array_compact(F.array(
        F.when(F.col("capped"), F.concat(F.lit("pdf_pages_capped: of "), F.col("total").cast("string"))), F.when(F.col("late"), F.lit("pdf_parse_time_capped")),
        F.when(F.size("unreadable") > 0, F.concat(F.lit("pdf_pages_unreadable: "), page_label(F.col("unreadable")))),
        F.when((F.size("_blank") > 0) & (F.size("kept") > 0), F.concat(F.lit("pdf_pages_without_text: "), page_label(F.col("_blank")))),
        F.when(F.size("_bad") > 0, F.concat(F.lit("pdf_text_degraded: "), page_label(F.col("_bad")))),
    ))
    markdown = F.array_join(F.transform("kept", lambda p: F.concat(F.lit("[p. "), p["page"].cast("string"), F.lit("]\n"), p["text"])), "\n\n")
    told = told.withColumn("warnings", warn).withColumn("markdown", markdown)
    verdict = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("total") == 0, "empty").when((F.size("kept") == 0) & (F.size("_blank") > 0), "image_only_pdf").otherwise(text_verdict(F.col("markdown"), F.col("markdown")))
    return told.withColumn("verdict", verdict).drop("_all", "_blank", "_bad")
