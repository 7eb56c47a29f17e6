"""Errors raised before or at the time a frame operation runs."""


class FrameError(Exception):
    """Base of all errors of this package."""


class ArgumentError(FrameError, ValueError):
    """An argument is invalid."""


class RangeError(ArgumentError, IndexError):
    """An index, offset or count is out of range."""


class MissingColumnError(FrameError, KeyError):
    """A column does not exist."""

    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""


class TypeMismatchError(ArgumentError, TypeError):
    """A value or column has another type than the operation needs."""


class NullValueError(ArgumentError):
    """A null where the operation needs a value."""


class EmptyFrameError(FrameError, ValueError):
    """An aggregate over no rows."""


class FormatError(FrameError, ValueError):
    """A file does not follow its format."""


class UnsupportedError(FrameError, NotImplementedError):
    """A file extension or value that the operation does not take."""


class StateError(FrameError, RuntimeError):
    """A connection or transaction is in a state that does not allow the call."""
