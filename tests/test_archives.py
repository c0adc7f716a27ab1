"""Archives: planning from their directories, ranges of entries, and entries that can't be inflated."""

import io
import os
import random
import struct
import zipfile

import pytest

from parcelmill.sources import archives, files

JPEG = bytes.fromhex("FFD8FFE0") + b"rest"


def packed(entries, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def codes(data):
    return [x[3] for x in archives.unzip(io.BytesIO(data))]


def test_rules_for_whole_archives():
    assert codes(b"nope") == codes(b"") == ["CORRUPT_ZIP"] and codes(packed({})) == ["EMPTY_ZIP"]
    for name in ("../escape.jpg", "a/../../b.jpg", "C:/x.jpg", "/abs.jpg", "..\\up.jpg"):
        assert codes(packed({"ok.jpg": b"x", name: b"x"})) == ["ZIP_PATH_TRAVERSAL"], name
    assert codes(packed({"big.jpg": b"0" * 10**6})) == ["ZIP_SUSPICIOUS_RATIO"]
    assert codes(packed({f"{k}.jpg": b"x" for k in range(501)})) == ["ZIP_TOO_MANY_ENTRIES"]
    assert codes(packed({"a.jpg": JPEG, "b.zip": b"inner", "read.me": b"x", "jpg": b"x", "d/": b""})) == [None, "SKIPPED", "SKIPPED", "SKIPPED"]


def test_nested_archives_do_not_count(monkeypatch):
    monkeypatch.setattr(archives, "MAX_UNPACKED", 1000)
    inner = os.urandom(5000)
    assert codes(packed({"big.zip": inner, "zeros.tar": b"0" * 10**6, "a.jpg": JPEG})) == ["SKIPPED", "SKIPPED", None]
    assert codes(packed({"a.jpg": os.urandom(600), "b.txt": os.urandom(600)})) == ["ZIP_TOO_LARGE"]


def flipped(data, at):
    return data[:at] + bytes([data[at] ^ 0xFF]) + data[at + 1 :]


@pytest.fixture(scope="module")
def damaged():
    """Four entries: sound, wrong checksum, encrypted, a method nobody knows."""
    rng = random.Random(1)
    bodies = {f"{k}.jpg": bytes([*b"\xff\xd8\xff", *(rng.randrange(256) for _ in range(200))]) for k in "abcd"}
    data = packed(bodies, zipfile.ZIP_STORED)
    data = flipped(data, data.index(bodies["b.jpg"]) + 50)
    central = [k for k in range(len(data)) if data[k : k + 4] == b"PK\x01\x02"]
    for k, offset, value in ((2, 8, 1), (3, 10, 77)):
        at = central[k] + offset
        data = data[:at] + struct.pack("<H", value) + data[at + 2 :]
    return data


def test_entries_that_cannot_be_inflated(spark, tmp_path, damaged):
    want = {"a.jpg": None, "b.jpg": "CORRUPT_ZIP", "c.jpg": "ENCRYPTED_ENTRY", "d.jpg": "UNSUPPORTED_COMPRESSION"}
    assert {x[1]: x[3] for x in archives.unzip(io.BytesIO(damaged))} == want
    (tmp_path / "x.zip").write_bytes(damaged)
    for most in (1, 10**9):
        rows = archives.entries(spark, str(tmp_path / "x.zip"), rangeBytes=most).collect()
        assert {r.name: r.code for r in rows} == want and all((r.content is None) == (r.code is not None) for r in rows)
    with pytest.raises(files.InvalidInput):
        files.inputs(spark, str(tmp_path / "x.zip"))
    df = spark.createDataFrame([("z", bytearray(damaged))], "path string, content binary")
    assert {r.name: r.code for r in files.unzipped(spark, df).collect()} == want


def test_a_task_has_a_range_of_entries(spark, tmp_path):
    rng = random.Random(2)
    made = {}
    for k in range(3):
        bodies = {f"d/{n}.png": rng.randbytes(rng.randrange(1, 60_000)) for n in range(40)}
        (tmp_path / f"{k}.ZIP").write_bytes(packed(bodies, rng.choice([zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])))
        made |= {(f"{k}.ZIP", n): b for n, b in bodies.items()}
    (tmp_path / "bad.zip").write_bytes(b"PK nothing")
    (tmp_path / "other.txt").write_bytes(b"x")
    most = 200_000
    parts = archives.ZipReader({"path": str(tmp_path), "rangeBytes": str(most)}).partitions()
    assert len(parts) > 12
    for p in parts:
        sizes = [len(made[os.path.basename(p.path), f"d/{n}.png"]) for n in p.places]
        assert len(sizes) == 1 or sum(sizes) <= most
    for url in (str(tmp_path), tmp_path.as_uri()):
        for planned in (1000, 2):  # the second: more archives than are planned, a task each
            rows = archives.entries(spark, url, rangeBytes=most, planned=planned).collect()
            assert {(os.path.basename(r.path), r.name): bytes(r.content) for r in rows if r.code is None} == made
            assert [(os.path.basename(r.path), r.code) for r in rows if r.code] == [("bad.zip", "CORRUPT_ZIP")]


def test_a_task_reads_its_range_only(tmp_path, monkeypatch):
    """Reading the last entry of a large archive touches its directory and that entry, not the bytes before."""
    bodies = {f"{n}.jpg": os.urandom(1 << 20) for n in range(30)}
    path = tmp_path / "large.zip"
    path.write_bytes(packed(bodies, zipfile.ZIP_STORED))
    reader = archives.ZipReader({"path": str(path), "rangeBytes": str(1 << 20)})
    read = [0]

    class Counted:
        def __init__(self, file):
            self.file = file

        def read(self, n=-1):
            got = self.file.read(n) if n >= 0 else self.file.read()
            read[0] += len(got)
            return got

        def __getattr__(self, name):
            return getattr(self.file, name)

    opened = archives.opened
    monkeypatch.setattr(archives, "opened", lambda file: opened(Counted(file)))
    parts = reader.partitions()
    assert len(parts) == 30 and read[0] < 1 << 17
    read[0] = 0
    (batch,) = reader.read(parts[-1])
    assert batch.column("content")[0].as_py() == bodies["29.jpg"] and read[0] < (1 << 20) + (1 << 17)


def test_empty_folder(spark, tmp_path):
    assert archives.entries(spark, str(tmp_path)).count() == 0
