"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

from quire.sources.staging import drop
from quire.sources.staging import staged as written

__all__ = ["drop", "written"]
