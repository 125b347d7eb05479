import os
from types import SimpleNamespace

import pytest

from corpuscle import session


class Conf(dict):
    def set(self, key, value):
        assert key != "spark.checkpoint.dir", "a core setting can't be changed in a running session"
        self[key] = value


def stub(master, **settings):
    return SimpleNamespace(conf=Conf(settings), sparkContext=SimpleNamespace(master=master))


def test_local_sessions_without_the_setting_share_one_folder():
    spark = stub("local[2]")
    first, second = session.scratch_path(spark, "a"), session.scratch_path(spark, "a")
    assert first != second and os.path.dirname(first) == os.path.dirname(second)


def test_the_shared_folder_is_taken_and_clusters_need_it():
    assert session.scratch_path(stub("spark://x", **{"spark.checkpoint.dir": "/shared"}), "a").startswith("/shared/a-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_path(stub("spark://x"), "a")
