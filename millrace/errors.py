"""Errors with a code and a message."""

OK, OOM, NOTFOUND, EXISTS, CORRUPT, IO, INVAL, BUSY = 0, -1, -2, -3, -4, -5, -6, -7
MESSAGES = {OK: "success", OOM: "out of memory", NOTFOUND: "not found", EXISTS: "already exists", CORRUPT: "corrupt data", IO: "I/O error", INVAL: "invalid argument", BUSY: "busy"}


def message(code: int) -> str:
    return MESSAGES.get(code, "unknown error")


class EngineError(Exception):
    def __init__(self, code: int, detail: str = ""):
        super().__init__(f"{message(code)}: {detail}" if detail else message(code))
        self.code = code
