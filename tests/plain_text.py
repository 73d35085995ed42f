"""A plain reader of chain text, line by line, that the library's is held against."""

import re

MAX_U32, MAX_U64 = 2**32 - 1, 2**64 - 1
_SPACE, _DIGITS, _INTEGER = re.compile(rb"[ \t\n\f\r]+"), re.compile(rb"[0-9]+\Z"), re.compile(rb"-?[0-9]+\Z")


class Fault(ValueError):
    pass


def words(line: bytes) -> list[bytes]:
    """Runs of other bytes than ASCII white space (a vertical tab is none)."""
    return [w for w in _SPACE.split(line) if w]


def unsigned(token: bytes, most: int, what: str) -> int:
    if not _DIGITS.match(token):
        raise Fault(f"{what} is not a number")
    if int(token) > most:
        raise Fault(f"{what} exceeds {'u32' if most == MAX_U32 else 'u64'}")
    return int(token)


def signed(token: bytes, what: str) -> int:
    """A 64-bit number; its least value and those beyond are refused."""
    if not _INTEGER.match(token) or not -(1 << 63) < int(token) < 1 << 63:
        raise Fault(f"{what} is not a 64-bit number")
    return int(token)


def parsed_header(line: bytes, need_id: bool = False) -> dict:
    """The fields of a header line; further words are passed over."""
    w = words(line)
    if not w or w[0] != b"chain":
        raise Fault("expected a chain header")
    if len(w) < 12:
        raise Fault("chain header is missing fields")
    if need_id and len(w) < 13:
        raise Fault("id missing")
    for at in (4, 9):
        if w[at] not in (b"+", b"-"):
            raise Fault("strand is neither + nor -")
    u32 = lambda at, what: unsigned(w[at], MAX_U32, what)
    sides = {}
    for p, at, what in (("r", 2, "reference"), ("q", 7, "query")):
        sides |= {f"{p}_name": w[at].decode("latin-1"), f"{p}_size": u32(at + 1, f"{what} size"), f"{p}_strand": w[at + 2].decode(), f"{p}_start": u32(at + 3, f"{what} start"), f"{p}_end": u32(at + 4, f"{what} end")}
    return {"score": signed(w[1], "score"), **sides, "id": unsigned(w[12], MAX_U64, "id") if len(w) > 12 else None, "id_explicit": len(w) > 12}


def parsed_block(line: bytes) -> tuple[int, int, int]:
    """Size, gap on the reference, gap on the query."""
    w = words(line)
    if len(w) == 2:
        raise Fault("block line missing dq value")
    values = [unsigned(x, MAX_U32, "block value") for x in w[:3]]
    return (*values, 0, 0) if len(values) == 1 else tuple(values)


def items(lines, stop=None, inside=False, metadata=True, need_id=False, wanted=None, number=None):
    """Metadata lines and chains among lines (offset, line, the next line's offset), in order; those that begin before stop.

    inside: the lines begin in a record that belongs to what precedes them, so all up
    to a blank line is passed over. wanted: of chains whose header it rejects, block
    lines are passed over unread and `blocks` is null. A chain's length counts its
    blank line. number: what the first header without an id gets, later ones the next
    numbers. A fault ends the lines: it is given as an item with an error.
    """
    now, at, past = None, 0, 0

    def ended(record):
        if record["blocks"] is not None and not record["blocks"]:
            raise Fault("chain without any alignment blocks")
        return record | {"length": past - record["offset"]}

    try:
        for at, line, past in lines:
            blank = not line or not words(line)
            if inside:
                if stop is not None and at >= stop:
                    return
                inside = not blank
            elif now is None:
                if stop is not None and at >= stop:
                    return
                if blank:
                    continue
                if line.startswith(b"#"):
                    if not metadata:
                        raise Fault("metadata line")
                    yield {"kind": "meta", "offset": at, "length": past - at, "line": (line[:-1] if line.endswith(b"\r") else line).decode("latin-1")}
                else:
                    head = parsed_header(line, need_id)
                    if number is not None and not head["id_explicit"]:
                        head["id"], number = number, number + 1
                    now = {"kind": "chain", "offset": at, "blocks": [] if wanted is None or wanted(head) else None, **head}
            elif blank:
                yield ended(now)
                now = None
            elif now["blocks"] is not None:
                now["blocks"].append(parsed_block(line))
        if now is not None:
            yield ended(now)
    except Fault as fault:
        yield {"kind": "error", "offset": at, "error": str(fault), "error_offset": at}


def lines(stream, at):
    for line in stream:
        past = at + len(line)
        yield at, line[:-1] if line.endswith(b"\n") else line, past
        at = past
