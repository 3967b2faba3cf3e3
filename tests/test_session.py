"""The checkpoint folder: shared, or refused."""

from types import SimpleNamespace

import pytest

from panelcraft import session
from panelcraft.session import scratch_table_dir


def fake(master, folder=None):
    made = []
    sc = SimpleNamespace(
        master=master,
        getCheckpointDir=lambda: made[0] if made else None,
        getConf=lambda: SimpleNamespace(get=lambda key, default: folder),
        setCheckpointDir=made.append,
    )
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default: None))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://x"])
def test_a_cluster_without_checkpoint_folder_is_refused(master):
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(fake(master))
    assert session.ensure_checkpoint_dir(fake(master, "hdfs://shared/ckpt")) == "hdfs://shared/ckpt"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_local_mode_makes_a_folder(master):
    assert session.ensure_checkpoint_dir(fake(master))


def test_scratch_folders_are_not_shared(spark):
    assert scratch_table_dir(spark, "x") != scratch_table_dir(spark, "x")
