"""Rental-customer analytics expressed as PySpark DataFrame jobs."""

from rentlens.session import build_session
from rentlens.workspace import Workspace, workspace_for

__all__ = ["Workspace", "build_session", "workspace_for"]
