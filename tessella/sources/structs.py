"""Declarative binary records whose later fields may take their length from earlier ones."""

from __future__ import annotations

import struct
from collections.abc import Callable

Length = int | str | Callable[[dict], int]


class Record:
    """Fields in order: Record(">").field("n", "H").array("tags", "H", "n").skip(2).text("name", "n")."""

    def __init__(self, order: str = "<"):
        self.order, self.steps = order, []

    def field(self, name: str, code: str) -> "Record":
        self.steps.append((name, code, None))
        return self

    def array(self, name: str, code: str, length: Length) -> "Record":
        self.steps.append((name, code, length))
        return self

    def text(self, name: str, length: Length) -> "Record":
        self.steps.append((name, "text", length))
        return self

    def skip(self, length: Length) -> "Record":
        self.steps.append(("", "skip", length))
        return self

    def read(self, data: bytes, at: int = 0) -> tuple[dict, int]:
        """The values and the position after them."""
        out: dict = {}
        for name, code, length in self.steps:
            n = 1 if length is None else out[length] if isinstance(length, str) else length(out) if callable(length) else length
            if code in ("skip", "text"):
                if code == "text":
                    out[name] = data[at : at + n].split(b"\0")[0].decode(errors="replace")
                at += n
                continue
            form = f"{self.order}{n}{code}"
            values = struct.unpack_from(form, data, at)
            out[name] = values[0] if length is None else list(values)
            at += struct.calcsize(form)
        return out, at
