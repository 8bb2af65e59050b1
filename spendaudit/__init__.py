"""Audit-risk screening of public-spending records on Spark DataFrames."""

from spendaudit.config import AuditConfig

__all__ = ["AuditConfig"]
