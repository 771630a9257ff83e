"""Archives with nested roots, paths that lead out, empty ones and entries in parts."""

import gzip
import io
import tarfile
import zipfile

import pytest

from codeloom.sources import archives as a

FILES = {"proj/src/a.py": b"x = 1\n", "proj/README.md": b"", "proj/big.bin": bytes(range(256)) * 40}


def make(folder, name, files):
    path = folder / name
    if name.endswith(".zip"):
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            z.mkdir("proj") if files is FILES else None
            for n, data in files.items():
                z.writestr(n, data)
    elif name.endswith(".gz") and ".tar" not in name:
        path.write_bytes(gzip.compress(next(iter(files.values()))))
    else:
        with tarfile.open(path, "w:gz" if name.endswith("gz") else "w") as t:
            for n, data in files.items():
                info = tarfile.TarInfo(n)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
            link = tarfile.TarInfo("proj/link")
            link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
            t.addfile(link) if files is FILES else None
    return str(path)


def whole(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.archive, r.path, r.part)):
        out[r.archive, r.path] = out.get((r.archive, r.path), b"") + bytes(r.content)
    return out


def test_all_kinds(spark, tmp_path):
    names = ["p.zip", "p.tar", "p.tar.gz", "P.TGZ"]
    for name in names:
        make(tmp_path, name, FILES)
    make(tmp_path, "one.txt.gz", {"x": b"single" * 100})
    (tmp_path / "other.txt").write_bytes(b"no archive")
    df = a.archive_files(spark, str(tmp_path), part_bytes=1000, partition_bytes=5000)
    want = {(n, p.removeprefix("proj/")): data for n in names for p, data in FILES.items()} | {("one.txt.gz", "one.txt"): b"single" * 100}
    assert whole(df) == want
    assert df.rdd.getNumPartitions() >= 7 and {r.part for r in df.where("path = 'big.bin'").collect()} == set(range(11))
    files = a.source_files(a.archive_files(spark, str(tmp_path)), [".py"])
    assert {(r.archive, r.path, r.content) for r in files.collect()} == {(n, "src/a.py", "x = 1\n") for n in names}
    assert whole(a.expanded(spark.read.format("binaryFile").load([f"{tmp_path}/{n}" for n in [*names, "one.txt.gz"]]), 1000)) == want


def test_roots(spark, tmp_path):
    paths = lambda files: {r.path for r in a.archive_files(spark, make(tmp_path, "r.zip", files)).collect()}
    assert paths({"a/b/c.py": b"", "a/b/d.py": b""}) == {"b/c.py", "b/d.py"}
    assert paths({"a/c.py": b"", "d.py": b""}) == {"a/c.py", "d.py"} and paths({"only.py": b""}) == {"only.py"}
    assert paths({"./a/x.py": b"", "a//y.py": b""}) == {"x.py", "y.py"}


@pytest.mark.parametrize("name", ["../x", "/etc/x", "a/../../x", "C:\\x", "a\\..\\..\\x"])
@pytest.mark.parametrize("kind", ["u.zip", "u.tar"])
def test_paths_that_lead_out(spark, tmp_path, name, kind):
    path = make(tmp_path, kind, {"ok.py": b"", name: b"bad"})
    with pytest.raises(Exception, match="leads out"):
        a.archive_files(spark, path).collect()


def test_empty_and_unknown(spark, tmp_path):
    assert a.archive_files(spark, make(tmp_path, "e.zip", {})).count() == 0
    assert a.archive_files(spark, make(tmp_path, "e.tar", {})).count() == 0
    (tmp_path / "none").mkdir()
    assert a.archive_files(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "x.br").write_bytes(b"")
    with pytest.raises(Exception, match="known kind"):
        a.archive_files(spark, str(tmp_path / "x.br")).collect()
