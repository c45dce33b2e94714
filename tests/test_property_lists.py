"""Property lists read by joins: what a dictionary says, and what each broken one lacks."""

import plistlib

import pytest

from attestry.sources import property_lists as pl


def _packed(value):
    return plistlib.dumps(value, fmt=plistlib.FMT_BINARY, sort_keys=False)


def _lines(value):
    if isinstance(value, bool):
        return ["<true/>" if value else "<false/>"]
    if isinstance(value, bytes):
        return [f"<data:{len(value)}>"]
    if isinstance(value, dict):
        return [line for k, v in value.items() for line in [k, *_lines(v)]]
    if isinstance(value, list):
        return [line for v in value for line in _lines(v)]
    return [str(value)]


def _nested(depth):
    out = "end"
    for _ in range(depth):
        out = [out]
    return out


def _raw(bodies, root=0):
    """A list of objects given as bytes, offsets of two and references of one byte."""
    data, at = b"bplist00", []
    for b in bodies:
        at.append(len(data))
        data += b
    return data + b"".join(x.to_bytes(2, "big") for x in at) + bytes(6) + b"\x02\x01" + len(bodies).to_bytes(8, "big") + root.to_bytes(8, "big") + len(data).to_bytes(8, "big")


GOOD = {
    "flat": {"a": 1, "b": True, "c": False, "d": "é ü", "e": "日本 😀", "f": b"xyz", "g": 2**40, "h": ""},
    "real": {"x": 0.5, "y": -2.25, "z": 3.0},
    "nested": {"NSAppTransportSecurity": {"NSAllowsArbitraryLoads": True}, "list": ["p", ["q", {"k": "p"}], []], "same": "p"},
    "long": {"s": "x" * 300, "l": list(range(40))},
    "root": "alone",
    "empty": {},
    "deepest": _nested(32),
}
FAIL = {
    "none": None,
    "short": b"bplist00",
    "xml": b"<?xml version='1.0'?>" + b" " * 40,
    "deep": _packed(_nested(33)),
    "cycle": _raw([b"\xa1\x01", b"\xa1\x00"]),
    "itself": _raw([b"\xa1\x00"]),
    "outside": _raw([b"\xa1\x05"]),
    "key twice": _raw([b"\xd2\x01\x02\x03\x03", b"\x51a", b"\x51a", b"\x09"]),
    "key number": _raw([b"\xd1\x01\x01", b"\x10\x07"]),
    "type": _raw([b"\xf0"]),
    "string": _raw([b"\x5f\x10\xff", b"\x09"]),
    "surrogate": _raw([b"\x61\xd8\x3d"]),
    "large integer": _raw([b"\x13" + b"\xff" * 8]),
    "root outside": _raw([b"\x09"], 3),
}


@pytest.fixture(scope="module")
def read(spark):
    doubled = [b"\xaa" + bytes([i + 1]) * 10 for i in range(30)] + [b"\x51z"]
    rows = [(k, _packed(v)) for k, v in GOOD.items()] + list(FAIL.items())
    rows += [("doubled", _raw(doubled)), ("nothing", _raw([b"\xaa" + bytes([i + 1]) * 10 for i in range(30)] + [b"\xa0"])), ("unreached", _raw([b"\x09", b"\xf0"]))]
    got = pl.decoded(spark.createDataFrame([(a, b, "extra") for a, b in rows], "artifact string, bytes binary, kind string"), 2_000)
    return {r["artifact"]: r for r in got.collect()}


def test_values(read):
    for name, value in GOOD.items():
        want = _lines(value) if name != "real" else ["x", "0.5", "y", "-2.25", "z", "3"]
        assert (read[name]["text"], read[name]["truncated"], read[name]["reason"]) == ("\n".join(want), False, None), name
    assert read["unreached"]["text"] == "<true/>"


def test_reasons(read):
    for name in FAIL:
        assert read[name]["text"] is None and read[name]["reason"], name
    assert "holds itself" in read["cycle"]["reason"] and "holds itself" in read["itself"]["reason"] and "key" in read["key twice"]["reason"] and "reference" in read["outside"]["reason"]
    assert len(read) == len(GOOD) + len(FAIL) + 3


def test_repeated_objects_stay_small(read):
    """Ten to the thirtieth lines, or none: neither is written out."""
    assert read["doubled"]["truncated"] and read["doubled"]["text"] == "\n".join("z" * 1_000)
    assert read["nothing"]["text"] == "" and not read["nothing"]["truncated"]


def test_no_lists(spark):
    assert pl.decoded(spark.createDataFrame([], "artifact string, bytes binary"), 100).collect() == []
