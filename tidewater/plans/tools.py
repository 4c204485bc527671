"""Read-only tools over a service, for a tool server."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from tidewater.errors import ConfigurationError
from tidewater.plans.service import KnowledgeService


def tools(service: KnowledgeService) -> dict[str, Callable[..., dict]]:
    """search_knowledge, get_document and get_chunk; a lookup that finds nothing says so."""

    def search_knowledge(query: str, strategy: str | None = None, max_results: int = 10) -> dict:
        return asdict(service.search(query, strategy=strategy, max_results=max_results))

    def get_document(document_id: str) -> dict:
        found = service.get_document(document_id)
        return {"found": found is not None, "document": found}

    def get_chunk(chunk_id: str) -> dict:
        found = service.get_chunk(chunk_id)
        return {"found": found is not None, "chunk": found}

    return {f.__name__: f for f in (search_knowledge, get_document, get_chunk)}


def serve(service: KnowledgeService) -> None:
    """Serves the tools over standard input and output, by the optional package mcp."""
    try:
        from mcp.server.fastmcp import FastMCP
    except ImportError as error:
        raise ConfigurationError("serve-tools needs the optional package mcp") from error
    server = FastMCP("tidewater")
    for tool in tools(service).values():
        server.tool()(tool)
    server.run("stdio")
