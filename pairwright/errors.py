"""Errors that name the stage that failed."""


class MatchmakingError(Exception):
    """Base of the errors raised here."""


class EmbeddingError(MatchmakingError):
    """A text could not be turned into a vector, or a vector has the wrong size."""


class StoreError(MatchmakingError):
    """A versioned table could not be read, written or promoted."""
