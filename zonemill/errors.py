"""Typed errors."""


class ZonemillError(Exception):
    """What all errors of the package are."""


class ConfigError(ZonemillError):
    """A configuration file is missing, no mapping, or lacks a key."""


class MissingRelationError(ZonemillError):
    """A requested relation is not in the source."""


class ProvenanceError(ZonemillError):
    """A file does not match its manifest."""


class SpatialAuditUnavailable(ZonemillError):
    """A boundary could not be assembled; there is no fallback to a box."""


class RoutingError(ZonemillError):
    """The routing service gave no usable answer."""
