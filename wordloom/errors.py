"""Errors of the engine, one class for each kind of failure."""


class WordloomError(Exception):
    """Base of all errors."""


class ContextError(WordloomError):
    """Another error, with what was being done when it came."""

    def __init__(self, doing: str, cause: Exception):
        super().__init__(f"{doing}: {cause}")
        self.__cause__ = cause


class FormatError(WordloomError):
    """A file does not follow its format."""


class NGramConversionError(WordloomError):
    """A sub-word vocabulary can't be written as an explicit one."""


class MatrixShapeError(WordloomError):
    """A matrix has not the shape its header or vocabulary says."""


class ReadError(WordloomError):
    """A file can't be read."""


class UnknownChunkError(WordloomError):
    """A container holds a chunk of unknown kind."""


class OverflowError_(WordloomError):
    """A number does not fit its field."""


class ConversionError(WordloomError):
    """A model can't be turned into another kind."""


class QuantizationError(WordloomError):
    """A matrix can't be quantized as asked."""


class WriteError(WordloomError):
    """A file can't be written."""


class AnalogyError(WordloomError):
    """A word of an analogy has no vector; ``present`` tells which have one."""

    def __init__(self, present: list[bool]):
        super().__init__(f"words present: {present}")
        self.present = present
