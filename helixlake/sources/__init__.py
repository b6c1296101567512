"""Readers and writers of sequence formats."""

from .datasources import register

__all__ = ["register"]
