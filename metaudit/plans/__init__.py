"""Every operator as a query over the given tables."""

from metaudit.plans import extensions, files, normalizers, reports, text, typed  # noqa: F401  (registers queries)
from metaudit.plans.base import ORACLES, QUERIES  # noqa: F401
