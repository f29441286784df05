"""All registered queries; importing the modules fills the registry."""

from meetlake.plans.queries import documents, history, models, podium, quality, service, sheets, sources  # noqa: F401
from meetlake.plans.registry import ORACLES, PLANS

__all__ = ["ORACLES", "PLANS"]
