"""History under several writers and compactions; archives read by ranges."""

import io
import tarfile
import threading

from waymark.operators.history import History
from waymark.sources import archives, files


def test_two_writers_and_a_compaction_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "h")
    made, failed = [], []

    def write(k):
        try:
            h = History(spark, path, most=0)
            for i in range(5):
                number = h.save(f"{k}-{i}", "low")
                h.set_status(number, "Verified")
                made.append((number, f"{k}-{i}"))
        except Exception as e:
            failed.append(e)

    def compact():
        try:
            for _ in range(4):
                History(spark, path).compact()
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=f) for f in (lambda: write("a"), lambda: write("b"), compact, compact)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    for _ in range(3):
        rows = History(spark, path).rows().collect()
        assert {(r["id"], r["subject"]) for r in rows} == set(made) and {r["status"] for r in rows} == {"Verified"}
        History(spark, path).compact()


def test_a_compaction_keeps_what_came_after_and_cleans_up(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"), most=0)
    assert h.rows().count() == 0 and not h.compact()
    one = h.save("one", "low")
    assert h.compact() and not h.compact()
    two = h.save("two", "high")
    h.set_status(one, "Closed")
    assert {(r["id"], r["status"]) for r in h.rows().collect()} == {(one, "Closed"), (two, "New")}
    assert h.compact()
    h.save("three", "none")
    assert h.compact()
    assert h.rows().count() == 3 and len(h._names("events")) == 1 and len(h._names("tables")) == 2
    # a manifest that someone else made first wins
    old = h._manifest()
    assert not h._publish({**old, "table": "lost"}) and h._manifest() == old
    few = History(spark, str(tmp_path / "few"), most=3)
    for k in range(6):
        few.save(str(k), "low")
    assert few.rows().count() == 6 and few._manifest()["number"] > 0


def test_members_of_archives_by_ranges(spark, tmp_path):
    contents = {f"top/{'deep/' * (k % 40)}f{k}.sql": bytes([65 + k % 26]) * (k * 37 % 3000) for k in range(200)}
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w") as tar:
        info = tarfile.TarInfo("top/inner.sql")
        info.size = 5
        tar.addfile(info, io.BytesIO(b"inner"))
    contents["top/nested.py"] = inner.getvalue()
    folder = tmp_path / "all"
    folder.mkdir()
    for name, mode in (("a.tar", "w"), ("b.tar.gz", "w:gz"), ("c.tgz", "w:gz")):
        with tarfile.open(folder / name, mode) as tar:
            d = tarfile.TarInfo("top")
            d.type = tarfile.DIRTYPE
            tar.addfile(d)
            for p, b in contents.items():
                info = tarfile.TarInfo(f"{name[0]}-{p}")
                info.size = len(b)
                tar.addfile(info, io.BytesIO(b))
    found = archives.members(spark, str(folder), size=20_000)
    assert {r["name"]: bytes(r["content"]) for r in found.collect()} == {f"{n}-{p}": b for n in "abc" for p, b in contents.items()}
    assert found.count() == 3 * len(contents)
    plain = archives.members(spark, str(folder / "a.tar"), most=100, size=20_000)
    assert plain.rdd.getNumPartitions() > 5
    assert all(len(r["content"]) == (r["length"] if r["length"] <= 100 else 0) for r in plain.collect())
    with tarfile.open(tmp_path / "empty.tar", "w"):
        pass
    assert archives.members(spark, str(tmp_path / "empty.tar")).count() == 0
    tree = files.read_archive(spark, str(folder / "b.tar.gz"))
    assert tree.files.where("file = 'f0.sql'").count() == 1
