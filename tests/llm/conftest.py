import pytest


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Write rows as Parquet tables of one data folder and return its path."""
    def make(**tables):
        path = str(tmp_path_factory.mktemp("tables"))
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return path

    return make
