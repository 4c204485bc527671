import pytest

from tidewater import errors
from tidewater.plans.config import load_config
from tidewater.plans.service import checked, status_of
from tidewater.sources.files import discovered, folder, read_text
from tidewater.sources.tables import shared_folder, spread


def test_a_file_outside_the_folder_is_refused(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "secret.md").write_text("outside")
    (tmp_path / "in" / "link.md").symlink_to(tmp_path / "secret.md")
    (tmp_path / "in" / "sub").symlink_to(tmp_path)
    (tmp_path / "in" / "a.md").write_text("inside")
    assert [r.path for r in discovered(spark, f"file:{tmp_path}/in", (".md",)).collect()] == ["a.md"]
    for path in ("../secret.md", "link.md", "sub/secret.md"):
        with pytest.raises(errors.SourceReadError, match="outside"):
            read_text(tmp_path / "in", path, 100)
    assert read_text(tmp_path / "in", "a.md", 6) == "inside"
    with pytest.raises(errors.SourceFileTooLargeError):
        read_text(tmp_path / "in", "a.md", 5)
    with pytest.raises(errors.SourceReadError, match="cannot read"):
        read_text(tmp_path / "in", "none.md", 5)


def test_folders_are_listed_level_by_level_and_read_in_slices(spark, tmp_path, monkeypatch):
    at = tmp_path / "deep docs"
    for k in range(40):
        into = at / f"f{k % 4}" / f"g{k % 3}" / ".h"
        into.mkdir(parents=True, exist_ok=True)
        (into / f"n{k}.MD").write_text("\ufeff" + "é" * k)
        (at / f"f{k % 4}" / f"x{k}.png").write_text("no")
    (at / "empty").mkdir()
    (at / "loop").symlink_to(at)
    asked = []
    monkeypatch.setattr("os.walk", lambda *a, **b: asked.append(a))
    for uri in (at, str(at), f"file:{at}", f"file://{at}"):
        got = folder(spark, "s", uri, slice_bytes=5000)
        rows = got.collect()
        assert {(r.source_id, r.relative_path, r.content) for r in rows} == {("s", f"f{k % 4}/g{k % 3}/.h/n{k}.MD", "é" * k) for k in range(40)} and len(rows) == 40
    assert not asked and got.rdd.getNumPartitions() >= 30
    assert folder(spark, "s", at / "empty").count() == 0
    (at / "f0" / "bad.md").write_bytes(b"\xff")
    with pytest.raises(Exception, match="cannot read f0/bad.md"):
        folder(spark, "s", at).collect()
    with pytest.raises(Exception, match="more than 3 bytes"):
        folder(spark, "s", at, extensions=(".png", ".MD"), max_file_bytes=3).collect()
    with pytest.raises(errors.SourceConfigurationError, match="not a folder"):
        folder(spark, "s", at / "f0" / "bad.md")


GOOD = '[source]\nsource_id = "s"\nroot = "docs"\n[persistence]\ndb_path = "store"\n'


def test_configuration(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text(GOOD + "[other]\nx = 1\n")
    found = load_config(path)
    assert (found.source_id, found.max_chunk_chars, found.default_strategy, found.embeddings_enabled) == ("s", 1000, "lexical", False)
    assert found.root == tmp_path / "docs" and found.db_path == tmp_path / "store"
    for bad in ("[source", GOOD.replace('"s"', '""'), GOOD + "[processing]\nmax_chunk_chars = 0\n", GOOD + "[retrieval]\ndefault_strategy = 'best'\n", GOOD + "[processing]\nother = 1\n", GOOD + "[embeddings]\nenabled = true\nprovider = 'other'\n", GOOD.replace('"docs"', "3"), "[source]\n"):
        path.write_text(bad)
        with pytest.raises(errors.ConfigurationError):
            load_config(path)
    with pytest.raises(errors.ConfigurationError):
        load_config(tmp_path / "none.toml")


def test_stored_rows_are_checked():
    document = {"document_id": "doc_" + "0" * 24, "source_id": "s", "relative_path": "a.md", "title": "a.md", "content_hash": "0" * 64, "processing_fingerprint": "f" * 64}
    assert checked(document, "document_id") == document
    for name, value in (("document_id", "doc_x"), ("content_hash", "F" * 64), ("processing_fingerprint", None), ("title", " "), ("source_id", None)):
        with pytest.raises(errors.StoreError, match=name):
            checked(document | {name: value}, "document_id")


def test_statuses():
    assert [status_of(n, 2) for n in range(4)] == ["empty", "success", "success", "partial"]


def test_shared_folder_needs_its_setting_on_a_cluster(spark):
    class Away:
        master = "spark://elsewhere:7077"

    class Session:
        sparkContext = Away
        conf = type("C", (), {"get": staticmethod(lambda name, default=None: default)})

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session)
    assert shared_folder(spark)


def test_small_tables_are_dealt_out(spark):
    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(100).repartition(9)
    assert spread(many) is many
