from tests.conftest import sf_small, spark  # noqa: F401
