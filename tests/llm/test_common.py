import types

import pytest

from waymark.llm import common


def test_a_cluster_must_name_a_shared_folder():
    for master, right in (("local", True), ("local[4]", True), ("local[4,2]", True), ("local-cluster[3,2,3000]", False), ("yarn", False), ("spark://a:7077", False)):
        class Spark:
            class conf:
                get = staticmethod(lambda key, default=None: default)
                set = staticmethod(lambda key, value: None)

            sparkContext = types.SimpleNamespace(master=master, setCheckpointDir=lambda path: None)
            sparkContext._jsc = types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: types.SimpleNamespace(isEmpty=lambda: True)))

        if right:
            assert common.shared_dir(Spark).startswith("file://")
        else:
            with pytest.raises(ValueError, match="checkpoint.dir"):
                common.shared_dir(Spark)
