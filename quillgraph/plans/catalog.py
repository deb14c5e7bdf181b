"""All registered queries of the library and their SQL equivalents."""

from __future__ import annotations

from quillgraph.plans import q_chat, q_decisions, q_document, q_graph, q_pipeline  # noqa: F401
from quillgraph.plans.q_chat import window_text  # noqa: F401
from quillgraph.plans.registry import ORACLES, QUERIES  # noqa: F401
