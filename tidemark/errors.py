"""The one error that users are meant to see."""


class EngineError(Exception):
    """Bad configuration, missing input or a source that cannot be read."""
