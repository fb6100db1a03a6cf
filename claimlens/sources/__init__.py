"""Table sources: the driver tables, materialised models and the generator."""

from claimlens.sources.model import ClaimsModel, empty_model  # noqa: F401
from claimlens.sources.tpch import derive_model, read_source  # noqa: F401
