"""The package's own catalogue of queries."""

from tessella.plans.registry import Catalogue

LLM = Catalogue()
