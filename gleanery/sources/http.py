"""Fetching over HTTP with retries, conditional requests and content decoding."""

from __future__ import annotations

import gzip
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from email.utils import format_datetime, parsedate_to_datetime
from datetime import datetime, timezone
from http.cookiejar import CookieJar
from urllib.parse import urlsplit

from gleanery.plans.config import SourceSpec

AGENT = "gleanery"


@dataclass
class Response:
    url: str
    status: int
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""

    def header(self, name: str) -> str | None:
        return next((v for k, v in self.headers.items() if k.lower() == name.lower()), None)

    def modified(self) -> datetime | None:
        value = self.header("Last-Modified")
        try:
            return parsedate_to_datetime(value) if value else None
        except ValueError:
            return None

    def text(self) -> str:
        kind = (self.header("Content-Type") or "").lower()
        charset = kind.partition("charset=")[2].split(";")[0].strip().strip('"')
        return self.body.decode(charset or "utf-8", "replace")


@dataclass
class Policy:
    """Retries and credentials of a source."""

    retries: int = 5
    wait: float = 60
    timeout: float = 180
    authorization: str | None = None

    @classmethod
    def of(cls, source: SourceSpec) -> "Policy":
        o = source.options
        return cls(int(o.get("retryCount", 5)), float(o.get("retryAfterSeconds", 60)), float(o.get("timeoutAfterSeconds", 180)), o.get("authorizationHeader"))


def decoded(body: bytes, encoding: str | None) -> bytes:
    for name in reversed([e.strip().lower() for e in (encoding or "").split(",") if e.strip()]):
        if name in ("gzip", "x-gzip"):
            body = gzip.decompress(body)
        elif name == "deflate":
            try:
                body = zlib.decompress(body)
            except zlib.error:
                body = zlib.decompress(body, -zlib.MAX_WBITS)
        elif name != "identity":
            raise OSError(f"unknown content encoding {name}")
    return body


def request(url: str, headers: dict[str, str], timeout: float) -> Response:
    """One GET; statuses of all kinds come back as responses."""
    if urlsplit(url).scheme not in ("http", "https"):
        raise ValueError(f"only http and https: {url}")
    opener = urllib.request.build_opener(urllib.request.HTTPCookieProcessor(CookieJar()))
    try:
        with opener.open(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
            return Response(r.url, r.status, dict(r.headers), decoded(r.read(), r.headers.get("Content-Encoding")))
    except urllib.error.HTTPError as e:
        return Response(url, e.code, dict(e.headers), b"")


def fetch(url: str, policy: Policy, since: datetime | None = None, accept: str = "text/xml, application/xml, */*", get: Callable[[str, dict[str, str], float], Response] = request, sleep: Callable[[float], None] = time.sleep) -> Response:
    """GET with policy.retries further attempts after network errors and statuses of 500 and over; Retry-After sets the
    wait after a 503. 304 comes back as such when `since` was given."""
    headers = {"User-Agent": AGENT, "Accept": accept, "Accept-Encoding": "gzip, deflate, identity"}
    if policy.authorization:
        headers["Authorization"] = policy.authorization
    if since:
        headers["If-Modified-Since"] = format_datetime(since.astimezone(timezone.utc), usegmt=True)
    for attempt in range(policy.retries + 1):
        wait = policy.wait
        try:
            r = get(url, headers, policy.timeout)
            if r.status < 500:
                return r
            error: Exception = OSError(f"{url}: status {r.status}")
            if r.status == 503 and (after := r.header("Retry-After")):
                wait = float(after) if after.isdigit() else max(0.0, (parsedate_to_datetime(after) - datetime.now(timezone.utc)).total_seconds())
        except (OSError, zlib.error) as e:
            error = e
        if attempt == policy.retries:
            raise error
        sleep(wait)
    raise AssertionError("unreachable")
