"""What the engine refuses, with the codes SQL clients expect."""

from __future__ import annotations


class LakeError(Exception):
    code = 1105


class SyntaxRefused(LakeError):
    code = 1064


class NoSuchTable(LakeError):
    code = 1146


class TableExists(LakeError):
    code = 1050


class NoSuchSchema(LakeError):
    code = 1049


class SchemaExists(LakeError):
    code = 1007


class SchemaMissing(LakeError):
    code = 1008


class Cancelled(LakeError):
    code = 1317


class NoSuchQuery(LakeError):
    code = 1094


class ReadOnly(LakeError):
    code = 1290


class Incompatible(LakeError):
    """A batch that the table's schema cannot take."""


class Conflict(LakeError):
    """Another commit got in between."""


class Partial(LakeError):
    """A source of the answer is missing and the policy is to reject."""
