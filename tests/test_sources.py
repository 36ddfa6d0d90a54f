import io
import tarfile

import pytest

from waymark.sources import extract, files, notices


def test_tree_and_archive_by_one_rule(spark, tmp_path):
    root = tmp_path / "build" / "repo"  # the folder the tree stands in doesn't count
    contents = {
        "a.sql": b"SELECT 1", "b.sql.j2": b"SELECT 2", "c.sql.bak": b"SELECT 3", "x/d.py": b"pass", "node_modules/e.sql": b"SELECT 4", "f.ipynb": b"{}", "g.md": b"#", "big.sql": b"x" * 2_000_001,
        "bom.sql": b"\xef\xbb\xbfSELECT 5", "wide.sql": "SELECT ü".encode("utf-16"), "nobom.sql": "SELECT 6".encode("utf-16-le"), "nul.sql": b"SELECT \0 7", "latin.sql": "SELECT 'é'".encode("latin-1"), "long.sql": "SELECT 8".encode("utf-32"), "target/n.txt": b"x",
    }
    for p, b in contents.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(b)
    path = tmp_path / "r.tar.gz"
    with tarfile.open(path, "w:gz") as tar:
        for p, b in contents.items():
            info = tarfile.TarInfo(f"owner-repo-0123abc/{p}")
            info.size = len(b)
            tar.addfile(info, io.BytesIO(b))
    for tree in (files.read_tree(spark, str(root)), files.read_archive(spark, str(path))):
        got = {r["file"]: r["text"] for r in tree.files.collect()}
        assert set(got) == {"a.sql", "b.sql.j2", "x/d.py", "bom.sql", "wide.sql", "nobom.sql", "latin.sql", "long.sql"}
        assert got["long.sql"] == "SELECT 8" and got["bom.sql"] == "SELECT 5" and got["wide.sql"] == "SELECT ü" and got["nobom.sql"] == "SELECT 6" and got["latin.sql"] == "SELECT 'é'"
        kinds = {r["file"]: r["kind"] for r in tree.unread.collect()}
        assert kinds == {"c.sql.bak": "not_code", "node_modules/e.sql": "skipped_folder", "f.ipynb": "unknown_type", "g.md": "not_code", "big.sql": "too_long", "nul.sql": "not_text", "target/n.txt": "ignored"}


def test_repository_names():
    assert files.repository("a/b") == ("a", "b", "")
    assert files.repository("https://host.example/a/b.git") == ("a", "b", "")
    assert files.repository("https://host.example/a/b/tree/dev/x") == ("a", "b", "dev/x")
    assert files.archive_commit("o-r-0123abcdef") == "0123abcdef"
    with pytest.raises(ValueError):
        files.repository("nothing here")


def sqls(text, ext):
    return [(b.strip().split("\n")[0][:24], line) for b, line in extract.blocks(text, ext)]


def test_programs():
    text = 'x = 1\nq = """\nSELECT a\nFROM t\n"""\ns = ("INSERT INTO u "\n     "SELECT b FROM v")\nd = "nothing of interest in this string at all, really"\n'
    assert sqls(text, ".py") == [("SELECT a", 1), ("INSERT INTO u ", 5)]
    assert sqls('sql = "CREATE TABLE p AS SELECT a "\nsql += "FROM t"\n', ".py") == [("CREATE TABLE p AS SELECT", 0)]
    assert len(extract.blocks('qs = ["SELECT a FROM t WHERE b = 1 AND c = 2 AND d = 3", "SELECT b FROM u WHERE c = 1 AND d = 2 AND e = 3"]', ".py")) == 2
    assert not extract.blocks('"""This helper will create the destination table and select rows from it."""', ".py")
    assert extract.more_than_taken('q = "SELECT a " + x + " FROM t"', ".py", [])


def test_shell_and_markup():
    assert sqls("bq query <<EOF\nSELECT a FROM t\nEOF\nbq query --x 'SELECT b FROM u'\n", ".sh") == [("SELECT a FROM t", 1), ("SELECT b FROM u", 3)]
    assert sqls("steps:\n  - name: a\n    sql: |\n      SELECT a\n      FROM t\n    next: b\n  - query: \"SELECT b FROM u\"\n", ".yaml") == [("SELECT a", 3), ("SELECT b FROM u", 6)]
    assert sqls("<a>\n<script><![CDATA[SELECT a FROM t WHERE b &lt; 1]]></script>\n</a>", ".xml")[0][1] == 1


def test_files_and_targets():
    assert extract.sql_files('run("jobs/load.sql")\nrun("x.sql.j2")', ".py") == [("jobs/load.sql", 1), ("x.sql.j2", 2)]
    text = 'df.write.saveAsTable("a.b")\njob(destination="p.d.c")\n{"destinationTable": {"projectId": "p", "tableId": "e"}}'
    assert extract.written_tables(text, ".py") == ["b", "c", "e"]


MAIL = b"""From: Ana Lima <ana@data.example>
To: all@x.example
Subject: Change to people
Date: Tue, 01 Sep 2026 10:00:00 +0000
Content-Type: text/plain

The column area_code on table people will change its format on 18 September 2026.
Please act.

Kind regards,
Ana Lima
Master Data Team
"""


def test_notices(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(MAIL)
    row = notices.read_mails(spark, str(tmp_path)).first()
    assert (row["subject"], row["from_name"], row["team"], row["sent"]) == ("Change to people", "Ana Lima", "Master Data Team", "2026-09-01")
    catalog = spark.createDataFrame([("raw.people", "PEOPLE", "area_code"), ("raw.people", "PEOPLE", "id"), ("raw.other", "OTHER", "team")], "table string, key string, column string")
    n = notices.read_mails(spark, str(tmp_path))
    got = notices.extract(n, catalog).first()
    assert (got["change"], got["effective"]) == ("value_change", "2026-09-18")
    assert [(a["table"], a["columns"], a["whole"]) for a in got["asks"]] == [("raw.people", ["area_code"], False)]
    whole = spark.createDataFrame([("f", "Notice", "The table people will be dropped.")], "file string, subject string, body string")
    assert [(a["table"], a["whole"]) for a in notices.extract(whole, catalog).first()["asks"]] == [("raw.people", True)]


def test_pasted():
    n = notices.enrich(notices.read_pasted("From: Bo <bo@x.example>\nSubject: Hi\n\nBody text.\n"))
    assert (n["from_name"], n["subject"], n["body"], n["source_system"]) == ("Bo", "Hi", "Body text.", "x")
