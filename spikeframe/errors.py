"""What can be wrong with a session or a request."""


class SessionError(Exception):
    """Any error of this package."""


class InvalidHeader(SessionError):
    """A file or variable header that can't be."""


class IncompleteRead(SessionError):
    """Fewer data than announced, or a range beyond them."""


class InvalidFrequency(SessionError):
    """A timestamp frequency that is not positive."""


class VariableNotFound(SessionError):
    """No variable of that name."""


class WrongKind(SessionError):
    """A variable of another kind."""


class DuplicateVariable(SessionError):
    """A name that is taken, or given twice."""


class InvalidValues(SessionError):
    """Values that don't fit one another."""


class PayloadTooLarge(SessionError):
    """A variable larger than the reader may load."""


class TickOverflow(SessionError):
    """Times that the format's ticks can't hold."""


class InvalidMetadata(SessionError):
    """Metadata that are no JSON."""
