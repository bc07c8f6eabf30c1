"""Typed rejections of requests."""

from __future__ import annotations


class Rejected(Exception):
    """A request that isn't served; ``reason`` is the class's name."""

    def __init__(self, detail: str = "", operation: str = "", request_id: str = "", reference: str | None = None):
        super().__init__(f"{type(self).__name__}: {detail}")
        self.reason, self.detail, self.operation, self.request_id, self.reference = type(self).__name__, detail, operation, request_id, reference


class Missing(Rejected):
    """Nothing has the reference."""


class FragileReferenceStale(Rejected):
    """The backing file or result has changed."""


class FragileReferenceBroken(Rejected):
    """The backing file is gone."""


class Oversized(Rejected):
    """A limit is above the configured one."""


class Unsupported(Rejected):
    """The operation doesn't apply here."""


class Unauthorized(Rejected):
    """A path leaves its root."""


class InvalidRequest(Rejected):
    """A limit is zero or a value malformed."""


class InvalidRange(Rejected):
    """A range is outside the text or inside a character."""


class InvalidQuery(Rejected):
    """A text query is empty or too large."""


class InvalidTimeWindow(Rejected):
    """A time window is empty, reversed or unparsable."""


class LimitExceeded(Rejected):
    """A collection limit is zero."""


class ConfigurationUnavailable(Rejected):
    """No configuration is active."""


class CollectionUnavailable(Rejected):
    """No source could be read."""
