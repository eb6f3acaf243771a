"""Cached requests to registries, and a workbook's cells. For ingest on the driver; results become tables."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import Any
from xml.etree import ElementTree

RETRY_STATUS = {429, 500, 502, 503, 504}


def with_retry(call: Callable[[], Any], attempts: int = 3, wait: float = 0.5) -> Any:
    """Call again after errors that may pass, a little later each time."""
    for k in range(1, attempts + 1):
        try:
            return call()
        except urllib.error.HTTPError as e:
            if e.code not in RETRY_STATUS or k == attempts:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if k == attempts:
                raise
        time.sleep(wait * k)
    return None


class CachedClient:
    """JSON over HTTP with a file for each request, named by the hash of its canonical form."""

    def __init__(self, folder: Path, use_cache: bool = True, timeout: int = 30, fetch: Callable[..., bytes] | None = None):
        self.folder, self.use_cache, self.timeout = folder, use_cache, timeout
        self.fetch = fetch or self._fetch

    def _fetch(self, url: str, body: bytes | None) -> bytes:
        request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/json", "Accept": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as r:  # noqa: S310
            return r.read()

    def _json(self, method: str, url: str, payload: dict | None) -> Any:
        form = json.dumps([method, url, payload], sort_keys=True, separators=(",", ":"))
        path = self.folder / f"{hashlib.sha256(form.encode()).hexdigest()}.json"
        if self.use_cache and path.exists():
            return json.loads(path.read_text())
        if method == "GET":
            full = f"{url}?{urllib.parse.urlencode(payload, doseq=True)}" if payload else url
            raw = with_retry(lambda: self.fetch(full, None))
        else:
            raw = with_retry(lambda: self.fetch(url, json.dumps(payload).encode()))
        made = json.loads(raw)
        if self.use_cache:
            self.folder.mkdir(parents=True, exist_ok=True)
            path.write_text(json.dumps(made))
        return made

    def get_json(self, url: str, params: dict | None = None) -> Any:
        return self._json("GET", url, params)

    def post_json(self, url: str, payload: dict) -> Any:
        return self._json("POST", url, payload)


def pages(client: CachedClient, url: str, payload: dict, limit: int, page: int = 500, last_offset: int = 14_999, key: str = "results") -> tuple[list[dict], bool]:
    """Records of a paged search up to limit, and whether the limit or the registry's own cut it short."""
    found: list[dict] = []
    total = None
    while len(found) < limit and len(found) <= last_offset:
        got = client.post_json(url, payload | {"offset": len(found), "limit": min(page, limit - len(found))})
        total = (got.get("meta") or {}).get("total", total)
        rows = got.get(key) or []
        found += rows
        if not rows or total is not None and len(found) >= total:
            break
    return found, total is not None and len(found) < total


def in_batches(ids: list[str], fetch: Callable[[list[str]], list[dict]], key: str, size: int = 200) -> list[dict]:
    """Records by id, in the order asked for; ids that are not found are left out."""
    by = {str(r[key]): r for a in range(0, len(ids), size) for r in fetch(ids[a : a + size])}
    return [by[i] for i in ids if i in by]


def workbook_rows(path: Path) -> list[list[str | None]]:
    """Cells of a workbook's first sheet as text."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    rows = []
    for row in sheet.iter(f"{{{ns['m']}}}row"):
        cells: dict[int, str | None] = {}
        for c in row.findall("m:c", ns):
            column = 0
            for ch in c.get("r", "A1"):
                if ch.isalpha():
                    column = column * 26 + ord(ch.upper()) - 64
            value = c.find("m:v", ns)
            text = None if value is None else value.text
            if c.get("t") == "s" and text is not None:
                text = shared[int(text)]
            elif c.get("t") == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
            cells[column - 1] = text
        rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return rows
