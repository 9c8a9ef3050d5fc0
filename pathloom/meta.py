"""What a keyed table is made of: hash kind, casing, key width, and the logical tables."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum


class HashKind(IntEnum):
    UNSPECIFIED = 0
    XXH64 = 1
    FNV1A32 = 2
    XXH3 = 3


class Casing(IntEnum):
    SENSITIVE = 0
    INSENSITIVE = 1


class KeyWidth(IntEnum):
    """Bytes of a key; keys are unsigned and held as the bigint of the same bits."""

    U32 = 4
    U64 = 8

    @property
    def hex_digits(self) -> int:
        return 2 * self.value


@dataclass(frozen=True)
class TableMeta:
    key_width: KeyWidth = KeyWidth.U64
    hash_kind: HashKind = HashKind.UNSPECIFIED
    casing: Casing = Casing.INSENSITIVE

    @property
    def algorithm(self) -> HashKind:
        """The hash in use: an unspecified one is that which the key width implies."""
        if self.hash_kind is not HashKind.UNSPECIFIED:
            return self.hash_kind
        return HashKind.FNV1A32 if self.key_width is KeyWidth.U32 else HashKind.XXH64


@dataclass(frozen=True)
class LogicalTable:
    id: str
    meta: TableMeta
    input: str
    split: bool = False
    lowercase_output: bool = False


def _u64(kind: HashKind) -> TableMeta:
    return TableMeta(KeyWidth.U64, kind)


_U32 = TableMeta(KeyWidth.U32, HashKind.FNV1A32)
# The logical tables, their ids and their input files.
TABLES = {
    t.id: t
    for t in (
        LogicalTable("game", _u64(HashKind.XXH64), "hashes.game.txt", split=True, lowercase_output=True),
        LogicalTable("lcu", _u64(HashKind.XXH64), "hashes.lcu.txt", lowercase_output=True),
        LogicalTable("binentries", _U32, "hashes.binentries.txt"),
        LogicalTable("bintypes", _U32, "hashes.bintypes.txt"),
        LogicalTable("binfields", _U32, "hashes.binfields.txt"),
        LogicalTable("binhashes", _U32, "hashes.binhashes.txt"),
        LogicalTable("rst", _u64(HashKind.XXH64), "hashes.rst.xxh64.txt", lowercase_output=True),
        LogicalTable("rst-xxh3", _u64(HashKind.XXH3), "hashes.rst.xxh3.txt", lowercase_output=True),
    )
}
MAX_PATH_BYTES = 65535
