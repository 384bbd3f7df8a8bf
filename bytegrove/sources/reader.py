"""A content as a Python file, for plugins that parse streams."""

from __future__ import annotations

import io

from ..plans.ordered import Item


class ItemReader(io.RawIOBase):
    """Reads an Item. At its end and past it reads give nothing; bytes that should be there but
    can't be read raise EOFError; positions below zero raise ValueError; seeking past the end is fine.
    """

    def __init__(self, item: Item):
        self._item, self._at = item, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        start = {io.SEEK_SET: 0, io.SEEK_CUR: self._at, io.SEEK_END: self._item.size}[whence]
        if start + offset < 0:
            raise ValueError("seek to a negative position")
        self._at = start + offset
        return self._at

    def readinto(self, buffer) -> int:
        left = self._item.size - self._at
        if not len(buffer) or left <= 0:
            return 0
        data = self._item.read(self._at, min(len(buffer), left))
        if data is None:
            raise EOFError("a read failed before the end of the content")
        buffer[: len(data)] = data
        self._at += len(data)
        return len(data)
