"""Records that come in pages: how to ask for the next one, and when to stop."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass


@dataclass(frozen=True)
class Paging:
    """style: none, page (numbered), offset, cursor or next_link. The names of parameters and of fields in a reply are the interface's own."""

    style: str = "none"
    size: int = 50
    page: str = "page"
    first: int = 1
    offset: str = "offset"
    limit: str = "limit"
    cursor: str = "cursor"
    next_field: str = "next"
    max_pages: int = 1_000
    max_rows: int = 1_000_000

    def __post_init__(self):
        if self.style not in ("none", "page", "offset", "cursor", "next_link"):
            raise ValueError(f"unknown paging {self.style!r}")
        if self.size < 1 or self.max_pages < 1 or self.max_rows < 1:
            raise ValueError("sizes and bounds of paging must be positive")


def pages(fetch: Callable[[dict], tuple[list, dict]], paging: Paging) -> Iterator[list]:
    """The records of each page. fetch: parameters to (records, reply). Ends at a page without records, a missing or repeated cursor, or a bound; the last page is cut to the bound of rows."""
    params: dict = {"page": {paging.page: paging.first, paging.limit: paging.size}, "offset": {paging.offset: 0, paging.limit: paging.size}}.get(paging.style, {})
    seen, rows = set(), 0
    for _ in range(paging.max_pages):
        records, reply = fetch(dict(params))
        records = records[: paging.max_rows - rows]
        if not records:
            return
        rows += len(records)
        yield records
        if rows >= paging.max_rows or paging.style == "none":
            return
        if paging.style == "page":
            params[paging.page] += 1
        elif paging.style == "offset":
            params[paging.offset] += len(records)
        else:
            nxt = reply.get(paging.next_field)
            if not nxt or nxt in seen:
                return
            seen.add(nxt)
            params = {"url" if paging.style == "next_link" else paging.cursor: nxt}
