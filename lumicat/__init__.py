"""Media-catalog search, scoring and metering as Spark DataFrame operators."""

from lumicat.catalog import Catalog
from lumicat.session import build_session, tune

__all__ = ["Catalog", "build_session", "tune"]
