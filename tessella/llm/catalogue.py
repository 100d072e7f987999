"""All queries of this package; importing this module registers them."""

from tessella.llm import queries  # noqa: F401
from tessella.llm.base import LLM

__all__ = ["LLM"]
