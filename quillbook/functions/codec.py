"""Binary layout of framed exchange messages, in native column functions.

All integers are big-endian and unsigned.  A message is an 11-byte header (type,
locate, tracking, 48-bit nanoseconds) and the fields of its type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The length of every known message type.
LENGTHS = {
    "A": 36, "F": 40, "E": 31, "C": 36, "X": 23, "D": 19, "U": 35, "R": 39, "S": 12, "H": 25, "Y": 20, "L": 26,
    "V": 35, "W": 12, "K": 28, "J": 35, "h": 21, "P": 44, "Q": 40, "B": 19, "I": 50, "N": 20, "O": 48,
}
# Place, width and kind of the fields of the decoded types.
FIELDS = {
    "A": (("ref", 11, 8, "u"), ("side", 19, 1, "c"), ("shares", 20, 4, "u"), ("stock", 24, 8, "s"), ("price", 32, 4, "u")),
    "F": (("ref", 11, 8, "u"), ("side", 19, 1, "c"), ("shares", 20, 4, "u"), ("stock", 24, 8, "s"), ("price", 32, 4, "u"), ("mpid", 36, 4, "s")),
    "E": (("ref", 11, 8, "u"), ("shares", 19, 4, "u"), ("match_no", 23, 8, "u")),
    "C": (("ref", 11, 8, "u"), ("shares", 19, 4, "u"), ("match_no", 23, 8, "u"), ("printable", 31, 1, "c"), ("exec_price", 32, 4, "u")),
    "X": (("ref", 11, 8, "u"), ("shares", 19, 4, "u")),
    "D": (("ref", 11, 8, "u"),),
    "U": (("ref", 11, 8, "u"), ("new_ref", 19, 8, "u"), ("shares", 27, 4, "u"), ("price", 31, 4, "u")),
    "R": (("stock", 11, 8, "s"), ("market_category", 19, 1, "c"), ("financial_status", 20, 1, "c"), ("round_lot", 21, 4, "u"), ("round_lots_only", 25, 1, "c")),
    "S": (("event_code", 11, 1, "c"),),
    "H": (("stock", 11, 8, "s"), ("state", 19, 1, "c"), ("reason", 21, 4, "s")),
}
HEADER = (("locate", 1, 2, "u"), ("tracking", 3, 2, "u"), ("ts_ns", 5, 6, "u"))
BOOK_TYPES = ("A", "F", "E", "C", "X", "D", "U")
#: All decoded fields with their Spark types, in the order of the message table.
SCHEMA = {
    "type": "string", "locate": "int", "tracking": "int", "ts_ns": "long", "ref": "long", "new_ref": "long", "side": "string",
    "shares": "long", "price": "long", "stock": "string", "mpid": "string", "attributed": "boolean", "match_no": "long",
    "printable": "boolean", "exec_price": "long", "market_category": "string", "financial_status": "string", "round_lot": "long",
    "round_lots_only": "string", "event_code": "string", "state": "string", "reason": "string",
}


def load_be(body: Column, offset: int, width: int) -> Column:
    """``width`` bytes (1 to 8) as an integer; the upper half of 64 bits wraps to negative."""
    digits = F.hex(F.substring(body, offset + 1, width))
    if width < 8:
        return F.conv(digits, 16, 10).cast("long")
    wide = F.conv(digits, 16, 10).cast("decimal(20,0)")
    wrap = F.lit(str(1 << 64)).cast("decimal(20,0)")
    return F.when(wide >= F.lit(str(1 << 63)).cast("decimal(20,0)"), wide - wrap).otherwise(wide).cast("long")


def store_be(value: Column, width: int) -> Column:
    """An integer as ``width`` big-endian bytes."""
    return F.unhex(F.lpad(F.right(F.hex(value.cast("long")), F.lit(2 * width)), 2 * width, "0"))


def text_of(body: Column, offset: int, width: int) -> Column:
    """A space-padded field without its trailing spaces."""
    return F.rtrim(F.decode(F.substring(body, offset + 1, width), "ISO-8859-1"))


def padded(text: Column, width: int) -> Column:
    return F.encode(F.rpad(F.coalesce(text, F.lit("")), width, " "), "ISO-8859-1")


def type_of(body: Column) -> Column:
    return F.decode(F.substring(body, 1, 1), "ISO-8859-1")


def _lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def status_of(type_: Column, length: Column) -> Column:
    """``Empty``, ``UnknownType``, ``Truncated`` (shorter than its type's length),
    ``Other`` (known, not decoded) or ``Ok``; longer bodies are accepted."""
    need = _lookup(LENGTHS, type_)
    return (
        F.when(length == 0, "Empty").when(need.isNull(), "UnknownType").when(length < need, "Truncated")
        .when(type_.isin(*FIELDS), "Ok").otherwise("Other")
    )


def decoded(body: Column) -> dict[str, Column]:
    """A column for each field of ``SCHEMA``; null where the type lacks it or the body is short."""
    kind, length = type_of(body), F.length(body)
    ok = status_of(kind, length) == "Ok"
    out: dict[str, Column] = {"type": F.when(length > 0, kind)}
    for name, offset, width, _ in HEADER:
        out[name] = F.when(length >= 11, load_be(body, offset, width))
    by_field: dict[str, list[tuple[str, int, int, str]]] = {}
    for message, fields in FIELDS.items():
        for name, offset, width, how in fields:
            by_field.setdefault(name, []).append((message, offset, width, how))
    for name, places in by_field.items():
        value = None
        for message, offset, width, how in places:
            own = load_be(body, offset, width) if how == "u" else text_of(body, offset, width) if how == "s" else F.decode(F.substring(body, offset + 1, 1), "ISO-8859-1")
            value = F.when(kind == message, own) if value is None else value.when(kind == message, own)
        out[name] = F.when(ok, value)
    out["side"] = F.when(out["side"].isNotNull(), F.when(out["side"] == "B", "B").otherwise("S"))  # all but B sells
    out["printable"] = out["printable"] == "Y"
    out["attributed"] = F.when(ok & kind.isin("A", "F"), kind == "F")
    out["shares"] = F.when(ok & (kind == "D"), F.lit(0).cast("long")).otherwise(out["shares"])
    return {name: out[name].cast(kind_).alias(name) for name, kind_ in SCHEMA.items()}


def encoded(row: dict[str, Column]) -> Column:
    """The body of a message from its fields (inverse of ``decoded``); null for types not written."""
    def part(name: str, width: int, how: str) -> Column:
        value = row.get(name, F.lit(None).cast("string"))
        if how == "u":
            return store_be(F.coalesce(value.cast("long"), F.lit(0).cast("long")), width)
        if name == "printable":
            return F.encode(F.when(value.cast("boolean"), "Y").otherwise("N"), "ISO-8859-1")
        return padded(value, width)

    head = F.concat(F.encode(row["type"], "ISO-8859-1"), *[part(n, w, k) for n, _, w, k in HEADER])
    out = None
    for message, fields in FIELDS.items():
        at, parts = 11, [head]
        for name, offset, width, how in fields:
            if offset > at:
                parts.append(F.lit(bytes(offset - at)))
            parts.append(part(name, width, how))
            at = offset + width
        if at < LENGTHS[message]:  # fields that are not decoded
            parts.append(F.lit(bytes(LENGTHS[message] - at)))
        body = F.concat(*parts)
        out = F.when(row["type"] == message, body) if out is None else out.when(row["type"] == message, body)
    return out


def of_feed(locate: Column) -> dict[str, Column]:
    """The header's ``locate`` and ``tracking`` for a locate of more than two bytes, as
    tables of several feeds have it: the upper half, the number of the feed, goes where
    exchanges put numbers of their own."""
    wide = locate.cast("int")
    return {"locate": wide.bitwiseAND(F.lit(0xFFFF)), "tracking": F.shiftright(wide, 16).bitwiseAND(F.lit(0xFFFF))}


def over_feeds(locate: Column, tracking: Column) -> Column:
    """The locate that ``of_feed`` parted."""
    return F.shiftleft(tracking, 16).bitwiseOR(locate)


def framed(body: Column) -> Column:
    """A 16-bit length, then the body."""
    return F.concat(store_be(F.length(body), 2), body)
