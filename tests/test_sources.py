"""Archives read by executors, trees, and the two collections."""

import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.plans import derived
from quarry.sources import archive
from quarry.sources.archive import archive_files, archive_of, read_archive, safe_members
from quarry.sources.corpus import dotted_files, read_tree, read_zip

FILES = {
    "top/a.py": b"x = 1\n", "top/node_modules/b.py": b"y\n", "top/c.txt": b"no", "top/d.json": b"{}", "top/e.py": "é".encode("gbk"), "top/big.py": b"#" * 2_000_000,
    "top/s/F.java": b"class F {}\n", "__MACOSX/x.py": b"litter", "top/empty.py": b"",
}


@pytest.fixture
def packed(tmp_path):
    path = str(tmp_path / "p.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("top/", "")
        for name, data in FILES.items():
            z.writestr(name, data)
    return path


def test_members_are_read_by_partitions(spark, packed):
    rows = archive_files(spark, packed, partBytes=5)
    got = {r.rel_path: bytes(r.content) for r in rows.collect()}
    assert got == {n.removeprefix("top/"): d for n, d in FILES.items() if n.startswith("top/")}
    assert all(r.length == len(r.content) for r in rows.collect())
    assert rows.rdd.getNumPartitions() > 4


def test_an_archive_equals_its_tree(spark, packed, tmp_path):
    for name, data in FILES.items():
        if name.startswith("top/"):
            to = tmp_path / "tree" / name.removeprefix("top/")
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_bytes(data)
    def rows(df):
        return sorted(map(tuple, df.filter("bytes > 0").collect()), key=repr)

    for project in ("python", "java", "multi"):
        tree = rows(read_tree(spark, str(tmp_path / "tree"), 3, project))
        assert rows(read_archive(spark, packed, 3, project)) == rows(read_zip(spark, packed, 3, project)) == tree
    got = {r.rel_path: r.text for r in read_archive(spark, "file://" + packed, 1, "python").collect()}
    assert got == {"a.py": "x = 1\n", "d.json": "{}", "e.py": "é", "empty.py": ""}


def test_filters_keep_other_members_closed(packed):
    from pyspark.sql.datasource import GreaterThan, LessThanOrEqual, StringContains, StringEndsWith

    reader = archive.ProjectArchive({"path": packed}).reader(None)
    other = StringContains(("rel_path",), "e")
    assert [*reader.pushFilters([StringEndsWith(("rel_path",), ".py"), LessThanOrEqual(("length",), 100), other, GreaterThan(("length",), 0)])] == [other]
    assert [m[1] for p in reader.partitions() for m in p.members] == ["a.py", "node_modules/b.py", "e.py"]


def test_pushed_filters_give_the_same_rows(spark, packed):
    rows = archive_files(spark, packed).filter(F.col("rel_path").endswith(".py") & (F.col("length") <= 100)).select("rel_path")
    assert {r.rel_path for r in rows.collect()} == {"a.py", "node_modules/b.py", "e.py", "empty.py"}


@pytest.mark.parametrize("name", ["../out.py", "a/../../b.py", "/etc/x.py", "C:/x.py", "a\\b.py"])
def test_unsafe_names_are_refused(spark, tmp_path, name):
    with pytest.raises(ValueError, match="unsafe"):
        safe_members([name])
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr(name, "x")
    with pytest.raises(Exception, match="unsafe|refused"):
        archive_files(spark, str(tmp_path / "bad.zip")).collect()


def test_awkward_archives(spark, tmp_path, packed):
    with pytest.raises(ValueError, match="zip"):
        archive_files(spark, "x.tar")
    with pytest.raises(Exception, match="more than"):
        archive_files(spark, packed, maxBytes=1000).collect()
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    assert archive_files(spark, str(tmp_path / "none.zip")).count() == 0
    assert safe_members(["a/b.py", "c.py"]) == {"a/b.py": "a/b.py", "c.py": "c.py"}
    assert safe_members(["t/a.py", "t/b/c.py", "t/"]) == {"t/a.py": "a.py", "t/b/c.py": "b/c.py"}


def test_documents_go_through_an_archive(spark, tmp_path):
    """The corpus of a scale factor, packed and read again, is the same corpus."""
    files = derived.files(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "all.zip")
    archive_of(files, path)
    again = read_archive(spark, path, 1, partBytes=50_000)
    want = {(r.rel_path, r.text) for r in files.collect()}
    assert {(r.rel_path, r.text) for r in again.collect()} == want and len(want) == 200


def test_the_architecture_scan_has_its_own_walk(spark):
    rows = [("a/X.PY", 5), ("out/b.py", 5), (".github/c.py", 5), ("a/dist.py", 5), ("htmlcov/d.py", 5), ("e.java", 3 << 20), ("f.Java", 2 << 20), ("g.txt", 1)]
    files = spark.createDataFrame(rows, "rel_path string, length long")
    got = {r.rel_path: r.language for r in dotted_files(files).collect()}
    assert got == {"a/X.PY": "python", "a/dist.py": "python", "htmlcov/d.py": "python", "f.Java": "java"}
    assert dotted_files(files, ("java",)).count() == 1
