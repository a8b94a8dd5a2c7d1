"""Every operator over whole tables, each with the equivalent plain SQL where one exists."""

from . import cleaning, comparison, evaluation, forecasting, ingest, preparation, reporting, validation  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
