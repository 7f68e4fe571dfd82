import gzip

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillbook.functions import codec
from quillbook.sources import framed

# An add of 100 ABC at 12.3400, written out by hand.
ADD = (
    b"A" + (7).to_bytes(2, "big") + (1).to_bytes(2, "big") + (34_200_000_000_001).to_bytes(6, "big") + (2**63 + 5).to_bytes(8, "big") + b"B"
    + (100).to_bytes(4, "big") + b"ABC     " + (123_400).to_bytes(4, "big")
)
CROSS = b"Q" + bytes(39)


def decoded(spark, *bodies):
    df = spark.createDataFrame([("f", i, len(b), bytearray(b)) for i, b in enumerate(bodies)], framed.SCHEMA)
    return framed.decode(df).orderBy("idx").collect()


def test_golden(spark):
    (row,) = decoded(spark, ADD)
    assert (row.status, row.type, row.locate, row.tracking, row.ts_ns) == ("Ok", "A", 7, 1, 34_200_000_000_001)
    assert (row.ref, row.side, row.shares, row.stock, row.price, row.attributed) == (5 - 2**63, "B", 100, "ABC", 123_400, False)


def test_statuses(spark):
    found = decoded(spark, b"", b"z", ADD[:-1], ADD + b"more", CROSS, ADD[:11])
    assert [r.status for r in found] == ["Empty", "UnknownType", "Truncated", "Ok", "Other", "Truncated"]
    assert found[2].price is None and found[3].price == 123_400 and found[2].ts_ns == 34_200_000_000_001


@pytest.mark.parametrize("kind", sorted(codec.FIELDS))
def test_every_length(spark, kind):
    whole = kind.encode() + b"\x01" * (codec.LENGTHS[kind] - 1)
    found = decoded(spark, *[whole[:n] for n in range(1, len(whole) + 2)])
    assert [r.status for r in found] == ["Truncated"] * (len(whole) - 1) + ["Ok"] * (len(found) - len(whole) + 1)


def test_sides_other_than_buy_sell(spark):
    assert [r.side for r in decoded(spark, ADD.replace(b"B" + (100).to_bytes(4, "big"), b"?" + (100).to_bytes(4, "big")))] == ["S"]


def test_round_trip(spark):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in {
        "type": "C", "locate": 65_535, "tracking": 3, "ts_ns": 2**47, "ref": -1, "shares": 2**32 - 1, "match_no": 9, "printable": True, "exec_price": 5,
    }.items()])
    body = codec.encoded({c: F.col(c) for c in row.columns})
    got = row.select(body.alias("body")).select(*codec.decoded(F.col("body")).values()).first()
    assert all(got[c] == v for c, v in row.first().asDict().items())


def test_files(spark, tmp_path):
    bodies = [ADD, b"", CROSS, b"x" * 65_535] * 50
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bodies)], "idx long, body binary")
    for compression in ("none", "gzip"):
        out = str(tmp_path / compression)
        framed.write_framed(df, out, compression)
        back = framed.in_order(spark.read.format("framed").option("path", out).load()).orderBy("idx").collect()
        assert [bytes(r.body) for r in back] == bodies and [r.idx for r in back] == list(range(len(bodies)))
        split = framed.in_order(framed.split_frames(spark.read.format("binaryFile").load(out + "/part*"))).orderBy("idx").collect()
        assert [bytes(r.body) for r in split] == bodies
    assert framed.checksums(spark, str(tmp_path / "none")).count() >= 1


@pytest.mark.parametrize("cut, says", [(1, "inside a length prefix"), (10, "inside a message")])
def test_cut_streams(spark, tmp_path, cut, says):
    framed.register(spark)
    whole = len(ADD).to_bytes(2, "big") + ADD
    (tmp_path / "cut.frames").write_bytes(whole + whole[:cut])
    with pytest.raises(PySparkException, match=says):
        spark.read.format("framed").option("path", str(tmp_path / "cut.frames")).load().count()


def test_cut_gzip_and_missing_files(spark, tmp_path):
    framed.register(spark)
    whole = gzip.compress((len(ADD).to_bytes(2, "big") + ADD) * 1000)
    (tmp_path / "cut.frames.gz").write_bytes(whole[:-20])
    for name in ("cut.frames.gz", "absent"):
        with pytest.raises(PySparkException):
            spark.read.format("framed").option("path", str(tmp_path / name)).load().count()


def test_too_long(spark, tmp_path):
    df = spark.createDataFrame([(0, bytearray(65_536))], "idx long, body binary")
    with pytest.raises(PySparkException, match="does not fit a frame"):
        framed.write_framed(df, str(tmp_path / "long"))
