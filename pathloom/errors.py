"""Errors by area: opening, verifying, building, the manifest and the catalog."""

from __future__ import annotations


class OpenError(Exception):
    """A table file or a catalog's table cannot be opened."""


class BadMagic(OpenError):
    pass


class UnsupportedVersion(OpenError):
    pass


class MalformedHeader(OpenError):
    pass


class Malformed(OpenError):
    pass


class TableNotFound(OpenError):
    pass


class VerifyError(Exception):
    """A table's content contradicts itself."""


class ChecksumMismatch(VerifyError):
    pass


class BuildError(Exception):
    """Rows that no table can be built of."""


class DuplicateKey(BuildError):
    def __init__(self, key: int):
        super().__init__(f"key {key:#x} has two paths")
        self.key = key


class KeyOutOfRange(BuildError):
    def __init__(self, key: int):
        super().__init__(f"key {key:#x} is wider than 32 bits")
        self.key = key


class PathTooLong(BuildError):
    def __init__(self, key: int, length: int):
        super().__init__(f"the path of key {key:#x} has {length} bytes, over 65535")
        self.key, self.length = key, length


class ZeroFrameSize(BuildError):
    pass


class ListError(ValueError):
    """A line of a text list that cannot be parsed."""


class MergeConfig(ValueError):
    """Layers whose keys are not comparable."""


class ManifestError(Exception):
    pass


class ManifestMissing(ManifestError):
    pass


class UnsupportedSchema(ManifestError):
    pass


class CommitError(Exception):
    pass


class InvalidVersion(CommitError):
    pass


class VersionReused(CommitError):
    pass


class GcError(Exception):
    pass


class UpdateError(Exception):
    pass


class FetchFailed(UpdateError):
    def __init__(self, file: str, cause: BaseException):
        super().__init__(f"cannot fetch {file}: {cause}")
        self.file = file


class HttpStatus(UpdateError):
    """A server answered, but with a status other than 2xx."""

    def __init__(self, url: str, status: int):
        super().__init__(f"{url}: status {status}")
        self.url, self.status = url, status


class HttpTransport(UpdateError):
    """No answer came, or it broke off."""

    def __init__(self, url: str, cause: BaseException):
        super().__init__(f"{url}: {cause}")
        self.url = url


class DownloadMismatch(UpdateError):
    def __init__(self, file: str, expected: str, actual: str):
        super().__init__(f"{file}: expected sha256 {expected}, got {actual}")
        self.file, self.expected, self.actual = file, expected, actual


class BadRemoteFilename(UpdateError):
    pass


class NoCacheDir(Exception):
    pass
