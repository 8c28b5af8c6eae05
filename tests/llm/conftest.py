import pytest


@pytest.fixture(scope="session", autouse=True)
def checkpoint_folder(spark, tmp_path_factory):
    """A shared folder for checkpoints, only where the session has none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
