"""The shared folder with and without spark.checkpoint.dir; a running session takes no such setting."""

from types import SimpleNamespace

import pytest

from gridloom.session import shared_dir


class Conf(dict):
    def set(self, key, value):
        if key == "spark.checkpoint.dir":
            raise ValueError(key)
        self[key] = value


def session(master, **conf):
    return SimpleNamespace(conf=Conf(conf), sparkContext=SimpleNamespace(master=master))


def test_the_shared_folder():
    assert shared_dir(session("spark://host:7077", **{"spark.checkpoint.dir": "/shared/"})) == "/shared"
    local = session("local[2]")
    assert shared_dir(local) == shared_dir(local) != shared_dir(session("local[2]"))
    with pytest.raises(ValueError, match="all executors share"):
        shared_dir(session("spark://host:7077"))
