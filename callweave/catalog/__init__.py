"""All registered queries."""

from __future__ import annotations

from callweave.catalog import base


def _load() -> None:
    from callweave.catalog import calls, data, speech, text  # noqa: F401


def queries():
    _load()
    return dict(base.QUERIES)


def oracles():
    _load()
    return dict(base.ORACLES)
