"""A full refresh in pages that can be stopped and goes on where it was."""

from __future__ import annotations

from millrace.plans.catalog import Catalog
from millrace.plans.view import View
from millrace.sources.positions import Positions
from millrace.streaming.store import ViewStore


def backfill(view: View, catalog: Catalog, store: ViewStore, positions: Positions, job: str, pages: int = 8, most: int | None = None) -> bool:
    """Refresh the stored view page by page; whether it is complete.

    A page is a share of the store's buckets, so it is written once and alone, and a repeated page gives the same. Its
    number is saved when it is stored and removed with the last one. ``most`` pages are done at a time, if given.
    """
    done = positions.load(job, view.name) or 0
    last = pages if most is None else min(pages, done + most)
    for page in range(done, last):
        store.page(view, catalog, page, pages)
        positions.save(job, view.name, page + 1)
    if last == pages:
        positions.remove(job, view.name)
    return last == pages
