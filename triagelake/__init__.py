"""Forensic triage analytics expressed as Spark DataFrame operators."""

from triagelake.session import build_session
from triagelake.tables import CaseTables

__all__ = ["CaseTables", "build_session"]
