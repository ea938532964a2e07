import pytest

from quillstone.llm import store
from quillstone.llm.store import Scratch, clean, shared_dir


def test_tables_are_written_below_the_shared_folder(spark):
    scratch = Scratch(spark, "test")
    df = scratch.table("numbers", spark.range(5))
    assert scratch.root.startswith(shared_dir(spark) + "/quillstone/") and df.count() == 5
    assert df.inputFiles()[0].startswith("file:")
    scratch.drop("numbers", "never written")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(scratch.path("numbers"))


def test_clean_deletes_all_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_dir", lambda _: f"file://{tmp_path}")
    Scratch(spark, "test").table("one", spark.range(1))
    assert (tmp_path / "quillstone").exists()
    clean(spark)
    assert not (tmp_path / "quillstone").exists()
