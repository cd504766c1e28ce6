"""All registered queries (importing the modules registers them)."""

from __future__ import annotations

from . import (  # noqa: F401
    q_checked, q_linear, q_models, q_more, q_predict, q_probes, q_profile, q_quality, q_requests, q_sources, q_stream, q_workflow)
from .registry import REGISTRY


def queries():
    return {name: e.build for name, e in REGISTRY.items()}


def oracle_sql():
    return {name: e.oracle for name, e in REGISTRY.items() if e.oracle}
