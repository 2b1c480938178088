import pytest
from pyspark.sql import functions as F

from attestry.fixtures import Ledger, oracle
from tests.oracle_check import connect, differences

NAMES = ("submissions blocks ledger_content stored_messages stored_submissions alerts validations "
         "content_checks context_ie component_host trials milestones lifecycle policy key_history").split()


@pytest.mark.parametrize("name", NAMES)
def test_derived_table_matches_its_sql(spark, folder, name):
    problem = differences(spark, connect(folder), folder, lambda s, d: getattr(Ledger.at(s, d), name),
                          oracle(f"SELECT * FROM {name}"))
    assert problem is None


def test_messages_match_their_sql(spark, folder):
    def messages(s, d):
        return Ledger.at(s, d).messages.withColumn("error_code", F.col("error_code").cast("bigint"))

    sql = oracle("SELECT * EXCLUDE (error_code), CAST(error_code AS BIGINT) AS error_code FROM messages")
    assert differences(spark, connect(folder), folder, messages, sql) is None
