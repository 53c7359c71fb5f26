"""The key of the registered queries, by master and setting."""

from types import SimpleNamespace

import pytest

from parchment.llm import queries


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host"])
def test_a_cluster_without_a_key_draws_one(master):
    session = lambda **conf: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: conf.get(k, d)), sparkContext=SimpleNamespace(master=master))
    key = queries.pii_key(session())
    assert key == queries.pii_key(session()) and len(key) == 64 and key != queries.PII_TEST_KEY
    assert queries.pii_key(session(**{queries.PII_KEY_SETTING: "mine"})) == "mine"


def test_a_local_master_keeps_the_test_key(spark):
    assert queries.pii_key(spark) == queries.PII_TEST_KEY
