from types import SimpleNamespace

import pytest

from keyloom.plans.tables import shared_dir


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master, applicationId="a"))


def test_shared_folder():
    assert shared_dir(session("spark://x:7077", "s3a://b/c/"), "t").startswith("s3a://b/c/keyloom/t-")
    assert shared_dir(session("spark://x:7077", "/shared"), "t").startswith("file:///shared/keyloom/t-")
    assert shared_dir(session("local[2]"), "t").startswith("file:///")
    with pytest.raises(ValueError):
        shared_dir(session("spark://x:7077"), "t")
