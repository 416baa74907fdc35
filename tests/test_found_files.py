"""Files of a pattern are found and read by the tasks: the driver's plan names none of them."""

import pytest

from lumenfold.sources import captures, files


def _make(at):
    for k in range(3):
        for n in range(4):
            folder = at / str(k) / f"c{n}"
            (folder / "images").mkdir(parents=True)
            (folder / "scene.json").write_text(f'{{"M_s2h": [[{k}.0]], "extent": {n}.5, "floor_drop": 0.0}}')
            for name in ("a.jpg", "b.PNG", "_c.jpg", ".d.jpg", "e.Jpg", "jpg", "f.txt"):
                (folder / "images" / name).write_text("x")
    (at / "0" / "_c9").mkdir()
    (at / "0" / "_c9" / "scene.json").write_text("{}")
    (at / "0" / "note.json").write_text("{}")
    (at / "1" / "c7").mkdir()


def test_the_plan_names_no_file_of_a_capture(spark, tmp_path):
    _make(tmp_path)
    found = captures.scene(spark, f"{tmp_path}/*/*/scene.json", True)
    assert sorted((r.capture, r.M_s2h, r.extent) for r in found.collect()) == sorted((f"c{n}", [[float(k)]], n + 0.5) for k in range(3) for n in range(4))
    images = captures.image_files(spark, f"file://{tmp_path}/*/*/images", True)
    assert sorted((r.capture, r.path) for r in images.collect()) == sorted((f"c{n}", f"file:{tmp_path}/{k}/c{n}/images/{i}") for k in range(3) for n in range(4) for i in ("a.jpg", "b.PNG"))
    for df in (found, images):
        assert df.inputFiles() and not any(str(tmp_path) in f for f in df.inputFiles())


def test_patterns(spark, tmp_path):
    _make(tmp_path)
    names = lambda pattern: sorted(r.path.removeprefix(f"file:{tmp_path}/") for r in files.find(spark, f"{tmp_path}/{pattern}").collect())
    assert names("*/*.json") == ["0/note.json"]
    assert names("0/c[12]/scene.json") == ["0/c1/scene.json", "0/c2/scene.json"]
    assert names("?/c3/sc*.json") == [f"{k}/c3/scene.json" for k in range(3)]
    assert names("0/note.json") == ["0/note.json"]
    assert names("*/*/images/f.txt") == [f"{k}/c{n}/images/f.txt" for k in range(3) for n in range(4)]
    with pytest.raises(FileNotFoundError):
        files.find(spark, f"{tmp_path}/*/*/none.json")
    assert not files.tasks_reach(f"{tmp_path}/{{0,1}}/c*") and not files.tasks_reach("nostore://x/*/c") and files.tasks_reach(f"file://{tmp_path}/*/x")


def test_odd_documents(spark, tmp_path):
    for k, blob in enumerate((b"", b"{broken", b'\xef\xbb\xbf{"extent": 2.0}', b'{\n "extent":\n 3.0}')):
        (tmp_path / f"c{k}").mkdir()
        (tmp_path / f"c{k}" / "scene.json").write_bytes(blob)
    got = {r.capture: r.extent for r in captures.scene(spark, f"{tmp_path}/*/scene.json", True).collect()}
    assert got == {"c1": None, "c2": 2.0, "c3": 3.0}


def test_contents(spark, tmp_path):
    (tmp_path / "many").mkdir()
    for k in range(25):
        (tmp_path / "many" / f"{k}.bin").write_bytes(bytes([k]) * 10)
    found = files.find(spark, f"{tmp_path}/many/*.bin")
    assert {r.path.rsplit("/", 1)[-1]: bytes(r.content) for r in files.contents(found).collect()} == {f"{k}.bin": bytes([k]) * 10 for k in range(25)}
