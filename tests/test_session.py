from types import SimpleNamespace

import pytest

from vintagekit import session


def fake(master, named=None):
    context = SimpleNamespace(master=master, applicationId=f"app-{master}",
                              getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: named), sparkContext=context)


def test_named_folder_is_used_and_a_cluster_must_name_one():
    assert session.shared_dir(fake("yarn", "hdfs://x/check/")) == "hdfs://x/check"
    with pytest.raises(RuntimeError):
        session.shared_dir(fake("yarn"))


def test_local_master_gets_one_folder_per_application():
    local = fake("local[2]")
    assert session.shared_dir(local) == session.shared_dir(local)
    assert session.scratch_path(local, "x") != session.scratch_path(local, "x")
