"""Files that are streamed through their hash instead of being held."""

import hashlib
import os

from covenantry.sources import files as S


def test_streamed_files_have_their_sha256(spark, tmp_path):
    noise = os.urandom(3 << 20)
    bodies = {
        "noise.bin": noise, "ended.txt": b"a\nb\r\n" * 9000 + b"\n\n", "open.txt": b"\n" + b"a\r" * 9000, "mark.txt": b"\xef\xbb\xbf" + b"x\n" * 9000,
        "marked open.txt": b"\xef\xbb\xbf" + b"\n" * 9000 + b"x", "one line.pdf": b"z" * 100_000, "breaks.txt": b"\n" * 20_000, "small.txt": b"a\n",
        "packed.gz": noise[:50_000], "zero.bin": b"\0" * 50_000, "péché%20.txt": "é\n".encode() * 9000,
    }
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    part, spark_conf = "spark.sql.files.maxPartitionBytes", spark.conf
    before = spark_conf.get(part)
    spark_conf.set(part, str(100_000))  # so that files are read in several parts
    try:
        got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in S.hashed_files(spark, str(tmp_path), whole=1000).collect()}
    finally:
        spark_conf.set(part, before)
    assert got == {name: (len(body), hashlib.sha256(body).hexdigest()) for name, body in bodies.items()}
