"""Exceptions of the library."""


class DocsiftError(Exception):
    """Base of all."""


class StorageError(DocsiftError):
    """The store can't be read or written."""


class ConfigError(DocsiftError):
    """A setting, path or pattern is unusable."""


class NotFoundError(DocsiftError):
    """No such document."""


class CollectionExistsError(DocsiftError):
    """A collection of that name is there already."""


class EmbeddingError(DocsiftError):
    """The embedding model failed."""


class RerankError(DocsiftError):
    """The reranking model failed."""
