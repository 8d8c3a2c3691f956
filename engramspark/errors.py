"""The six kinds of error of the engine, and two of its service, with the HTTP status a server would answer."""


class EngramError(Exception):
    status = 500


class ValidationError(EngramError):
    status = 400


class ConflictError(EngramError):
    status = 409


class NotFoundError(EngramError):
    status = 404


class StorageError(EngramError):
    status = 500


class SerializationError(EngramError):
    status = 400


class CorruptionError(EngramError):
    status = 500


class AccessError(EngramError):
    status = 403


class LimitError(EngramError):
    status = 429
