"""Live fetches as a data source, off unless asked for: ``spark.read.format("guarded_fetch").option("urls", "...")``.

Queries read stored fetches; this source makes them.  Addresses are resolved
first, every resolved address must be public, the connection goes to the
checked address, bodies are bounded, and each redirect is checked again.
"""

from __future__ import annotations

import http.client
import ipaddress
import socket
import ssl
import zlib
from urllib.parse import urljoin, urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, method string, status int, body string, headers map<string,string>, error string"
MOST_BYTES, TIMEOUT, MOST_REDIRECTS = 5 << 20, 10.0, 5


def is_public(address: str) -> bool:
    ip = ipaddress.ip_address(address)
    mapped = getattr(ip, "ipv4_mapped", None)
    return (mapped or ip).is_global and not (mapped or ip).is_multicast


def checked_addresses(host: str, port: int) -> list[str]:
    """All addresses of a host; an error if any of them is not public."""
    found = sorted({info[4][0] for info in socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)})
    if not found or not all(map(is_public, found)):
        raise ValueError("unsafe host")
    return found


class _Pinned(http.client.HTTPSConnection):
    def __init__(self, address: str, host: str, port: int, secure: bool):
        super().__init__(host, port, timeout=TIMEOUT, context=ssl.create_default_context())
        self.address, self.secure = address, secure

    def connect(self) -> None:
        self.sock = socket.create_connection((self.address, self.port), self.timeout)
        if self.secure:
            self.sock = self._context.wrap_socket(self.sock, server_hostname=self.host)


def unpacked(raw: bytes, encoding: str) -> bytes:
    """At most MOST_BYTES of a gzip or deflate body."""
    if encoding in ("gzip", "deflate"):
        return zlib.decompressobj(47 if encoding == "gzip" else zlib.MAX_WBITS).decompress(raw, MOST_BYTES)
    return raw


def fetch(url: str, agent: str, method: str = "GET") -> tuple:
    """One row of SCHEMA; errors are told, not raised."""
    at = url
    try:
        for _ in range(MOST_REDIRECTS + 1):
            parts = urlsplit(at)
            if parts.scheme not in ("http", "https") or not parts.hostname:
                raise ValueError("unsafe scheme or host")
            secure = parts.scheme == "https"
            port = parts.port or (443 if secure else 80)
            connection = _Pinned(checked_addresses(parts.hostname, port)[0], parts.hostname, port, secure)
            try:
                connection.request(method, (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers={"User-Agent": agent, "Accept-Encoding": "gzip, deflate"})
                answer = connection.getresponse()
                headers = {k.lower(): v for k, v in answer.getheaders()}
                if answer.status in (301, 302, 303, 307, 308) and "location" in headers:
                    at = urljoin(at, headers["location"])
                    continue
                body = unpacked(answer.read(MOST_BYTES), headers.get("content-encoding", "").lower())
                return url, method, answer.status, body.decode("utf-8", "replace"), headers, None
            finally:
                connection.close()
        raise ValueError("too many redirects")
    except (OSError, ValueError, zlib.error, http.client.HTTPException) as error:
        return url, method, None, None, None, str(error)[:300]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.agent, self.method = options.get("agent", "crawlight"), options.get("method", "GET")

    def partitions(self):
        return [InputPartition(u) for u in self.urls]

    def read(self, partition):
        yield fetch(partition.value, self.agent, self.method)


class FetchSource(DataSource):
    @classmethod
    def name(cls):
        return "guarded_fetch"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)
