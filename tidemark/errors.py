"""Errors, with the exit code that the command line gives each."""


class TidemarkError(Exception):
    """An operation can't go on."""

    exit_code = 5


class ConfigError(TidemarkError):
    """A configuration or rule file is wrong."""

    exit_code = 2


class ScanError(TidemarkError):
    """A collection can't be scanned as a whole."""

    exit_code = 5


class SecretPolicyError(TidemarkError):
    """Secrets were found where none are allowed."""

    exit_code = 3


class VerificationError(TidemarkError):
    """An archive isn't what it says."""

    exit_code = 4
