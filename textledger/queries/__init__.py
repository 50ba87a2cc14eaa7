"""All registered queries: importing the modules registers them."""

from . import audit, catalog, readers, stores, streams, texts  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
