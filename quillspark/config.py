"""Settings of chunking and retrieval."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


# Defaults that results depend on.
@dataclass(frozen=True)
class RetrievalConfig:
    page_gate_words: int = 350  # a page with more words is cut by clause
    chunk_words: int = 400  # an open chunk with more words is split
    carried_share: float = 0.3  # of its lines, which then open the next chunk
    title_words: int = 40
    header_only_words: int = 8
    top_dense: int = 100
    top_sparse: int = 100
    min_similarity: float = 0.7
    rrf_k: int = 60
    rerank_pool: int = 200
    rrf_weight: float = 0.4
    rerank_weight: float = 0.6
    combined_threshold: float = 0.4
    rrf_threshold: float = 0.0000003
    min_chunks: int = 1
    max_chunks: int = 12
    per_entity: int = 2
    region_pages: int = 5
    ocr_trigger: int = 50
    preview_chars: int = 250
    rerank: bool = True  # off: the fused list alone decides
    dynamic_k: bool = True  # off: always max_chunks
    vector_size: int = 64  # of the default dense encoder

    @classmethod
    def from_env(cls, prefix: str = "QUILLSPARK_", env: dict[str, str] | None = None) -> RetrievalConfig:
        """The defaults, with what the environment sets, QUILLSPARK_TOP_DENSE=50 for instance. A value that can't be read is an error."""
        env = os.environ if env is None else env
        given = {f.name: env[name] for f in fields(cls) if (name := prefix + f.name.upper()) in env}
        read = lambda kind, x: x.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(x)
        return cls(**{name: read(type(getattr(cls, name)), value) for name, value in given.items()})


UNKNOWN_CUSTOMER = "Unknown Customer"
UNKNOWN_REGION = "Unknown Region"
PAGE_BREAK = "\n\n--- Page Break ---\n\n"
