import pytest

from cloakframe.llm.common import prepare


@pytest.fixture(autouse=True, scope="session")
def prepared(spark):
    prepare(spark)


@pytest.fixture()
def tables(spark, tmp_path):
    """Writes rows as the tables of a folder and gives the folder's path."""

    def write(**rows):
        for name, (data, schema) in rows.items():
            spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
