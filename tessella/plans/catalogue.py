"""All core queries; importing this module registers them."""

from tessella.plans import attention, contexts, graphs, patterns, records, signals, streams, structures, texts, times  # noqa: F401
from tessella.plans.registry import CORE

__all__ = ["CORE"]
