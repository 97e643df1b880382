"""What can go wrong, by the step in which it does."""


class QuireError(Exception):
    """Any failure of this engine's own."""


class ExtractionError(QuireError):
    """A source gave no pages."""


class TranslationError(QuireError):
    """A model gave no translation."""


class NotFound(QuireError):
    """No row has the key asked for."""


class InvalidDecision(QuireError):
    """A decision that isn't one of the enum's members."""
