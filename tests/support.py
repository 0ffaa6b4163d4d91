"""What several test modules use; a module name of its own, as every folder may have a conftest."""

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()
