"""Error kinds with their fixed prefixes, and the fixed texts that users see."""

from __future__ import annotations


class MarlstoneError(Exception):
    prefix = "error"

    def __str__(self) -> str:
        return f"{self.prefix}: {super().__str__()}"


class InvalidInput(MarlstoneError):
    prefix = "invalid input"


class NotImplementedFormat(MarlstoneError):
    prefix = "not implemented"


class ParseError(MarlstoneError):
    prefix = "parse error"


class ChunkingError(MarlstoneError):
    prefix = "chunking error"


class StorageError(MarlstoneError):
    prefix = "storage error"


class VectorIndexError(MarlstoneError):
    prefix = "vector index error"


class EmbeddingError(MarlstoneError):
    prefix = "embedding error"


class NetworkError(MarlstoneError):
    prefix = "network error"


class ConsistencyError(MarlstoneError):
    prefix = "consistency error"


class EmbeddingSpaceMismatch(MarlstoneError):
    prefix = "embedding-space mismatch"


# Texts that users see.
SUPPORTED_FORMATS = "markdown, html, text"
SUPPORTED_EXTENSIONS = ".md, .html, .htm"
PDF_NOT_IMPLEMENTED = "pdf ingest is not implemented yet (Phase 6); supported: .md, .html, .htm"


def unsupported_format(value: str) -> str:
    return f"unsupported format '{value}'. supported: {SUPPORTED_FORMATS}"


def unsupported_extension(extension: str) -> str:
    return f"unsupported file extension '{extension}'. supported: {SUPPORTED_EXTENSIONS}"
