"""Durable intermediate tables; see ``impactloom.durable``."""

from __future__ import annotations

from ..durable import Scratch, shared_folder

__all__ = ["Scratch", "shared_folder"]
