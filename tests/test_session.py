import pytest

from tidelog import session
from tidelog.session import clear, materialize, shared_dir, shared_path


class Fake:
    """A session with a given setting and master."""

    def __init__(self, given, master):
        class Conf:
            def get(self, name, default):
                assert name == "spark.checkpoint.dir"
                return given or default

        class Context:
            def __init__(self):
                self.master, self.folder = master, None

            def setCheckpointDir(self, folder):
                self.folder = folder

        self.conf, self.sparkContext = Conf(), Context()


def test_the_sessions_setting_is_used():
    assert shared_dir(Fake("hdfs://n/shared/", "spark://host:7077")) == "hdfs://n/shared"
    assert shared_path(Fake("/s", "local[2]"), "x").startswith("/s/tidelog/x-")


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError):
        shared_dir(Fake(None, "spark://host:7077"))


def test_a_local_session_gets_a_folder_of_its_own(monkeypatch):
    monkeypatch.setattr(session, "_own", [])
    fake = Fake(None, "local[2]")
    made = shared_dir(fake)
    assert made.startswith("file:///") and fake.sparkContext.folder == made and shared_dir(fake) == made


def test_materialize_and_clear(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(session, "_written", [])
    df = materialize(spark.range(3), "r")
    assert df.count() == 3 and list(tmp_path.glob("tidelog/r-*/*.parquet"))
    empty = materialize(spark.range(0), "e")
    assert empty.count() == 0 and empty.columns == ["id"]
    assert clear(spark) == 2 and not list(tmp_path.glob("tidelog/r-*"))


def test_scratch_tables_go_at_the_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(session, "_written", [])
    kept = materialize(spark.range(3), "kept")
    with pytest.raises(KeyError), session.scratch(spark):
        assert materialize(spark.range(4), "gone").count() == 4
        raise KeyError
    assert kept.count() == 3 and not list(tmp_path.glob("tidelog/gone-*")) and len(session._written) == 1
